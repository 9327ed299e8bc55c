"""Labels derived from the attributes of items and their contributors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.functions.text import basename, present, qualified, slash_parts
from labelwright.operators.dictionary import canonical_of

LEAST_AGE = 18


@dataclass(frozen=True)
class Bucket:
    low: int | None
    high: int | None
    label: str


def bucket_of(value: Column, buckets: list[Bucket]) -> Column:
    """The label of the first bucket that holds the value; a missing bound is open."""
    out = F.lit(None).cast("string")
    for b in reversed(buckets):
        inside = F.lit(True)
        if b.low is not None:
            inside = inside & (value >= b.low)
        if b.high is not None:
            inside = inside & (value <= b.high)
        out = F.when(inside, b.label).otherwise(out)
    return out


def age(birth: Column, at: Column) -> Column:
    """Whole calendar years; one born on 29 February has their day on the 28th in other years."""
    return F.floor(F.months_between(at, birth) / 12).cast("int")


def category_code(category: Column) -> Column:
    return F.coalesce(F.when(category == "FEMALE", "F").when(category == "MALE", "M").when(category == "OTHER", "X"), F.lit("U"))


def category_word(category: Column) -> Column:
    return F.coalesce(F.when(category == "FEMALE", "Female").when(category == "MALE", "Male").when(category == "OTHER", "Other"), F.lit("Unknown"))


def ages(people: DataFrame, buckets: list[Bucket], least: int = LEAST_AGE, with_code: bool = True) -> DataFrame:
    """item_id, contributor_id, name (null on failure), failure: age labels of ``people`` (item_date, birth_date, category)."""
    years = age(F.col("birth_date"), F.col("item_date"))
    label = bucket_of(years, buckets)
    failure = F.when(F.col("item_date").isNull(), "no item date").when(years < least, "below minimum").when(label.isNull(), "no bucket")
    named = qualified(label, category_code(F.col("category"))) if with_code else label
    return people.where("birth_date IS NOT NULL").select("item_id", "contributor_id", F.when(failure.isNull(), named).alias("name"), failure.alias("failure"))


def metrics(people: DataFrame, column: str, buckets: list[Bucket], low: int, high: int, with_code: bool = True) -> DataFrame:
    """As ``ages`` for a figure kept as number or text: blank is skipped, what is no integer or out of range fails."""
    text = F.trim(F.col(column).cast("string"))
    value = text.try_cast("int")
    label = bucket_of(value, buckets)
    failure = F.when(value.isNull(), "not an integer").when(~value.between(low, high), "out of range").when(label.isNull(), "no bucket")
    named = qualified(label, category_code(F.col("category"))) if with_code else label
    rows = people.where(F.coalesce(text, F.lit("")) != "")
    return rows.select("item_id", "contributor_id", F.when(failure.isNull(), named).alias("name"), failure.alias("failure"))


def countries(people: DataFrame, aliases: DataFrame, norm: str = "country_norm", prefix: str = "Country: ") -> DataFrame:
    """item_id, name of every contributor's country that the aliases know."""
    known = canonical_of(people, aliases, norm).where("canonical IS NOT NULL")
    return known.select("item_id", F.concat(F.lit(prefix), "canonical").alias("name")).distinct()


def groups(people: DataFrame, aliases: DataFrame, prefix: str = "Group: ", diverse: str = "Group: Mixed") -> DataFrame:
    """item_id, name: each contributor's first known group of a text with slashes, with their category word; and the diversity label."""
    each = people.select("item_id", "contributor_id", "category", F.posexplode(slash_parts(F.col("group_text"))).alias("pos", "part"))
    each = canonical_of(each.withColumn("norm", F.lower("part")), aliases, "norm").where("canonical IS NOT NULL")
    first = each.groupBy("item_id", "contributor_id", "category").agg(F.min_by("canonical", "pos").alias("canonical"))
    named = first.select("item_id", qualified(F.concat(F.lit(prefix), "canonical"), category_word(F.col("category"))).alias("name"))
    mixed = first.groupBy("item_id").agg(F.countDistinct("canonical").alias("n")).where("n >= 2").select("item_id", F.lit(diverse).alias("name"))
    return named.unionByName(mixed).distinct()


def composition(people: DataFrame, order: tuple[str, ...] = ("M", "F", "X", "U"), ceiling: int = 8, cap: int = 5, group: str = "Cast: Group", prefix: str = "Cast: ") -> DataFrame:
    """item_id, name: counts of contributors per category code in a fixed order ("2M1F"), or the group label for large casts."""
    code = category_code(F.col("category"))
    n = people.groupBy("item_id").agg(F.count("*").alias("total"), *(F.count_if(code == c).alias(c) for c in order))
    notation = F.concat_ws("", *(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(c))) for c in order))
    big = (F.col("total") >= ceiling) | (F.greatest(*order) >= cap)
    return n.select("item_id", F.when(big, group).otherwise(F.concat(F.lit(prefix), notation)).alias("name"))


def presence(people: DataFrame, columns: dict[str, str]) -> DataFrame:
    """item_id, name: the label of each free-text column that says something for any contributor."""
    out = None
    for column, label in columns.items():
        part = people.where(present(F.col(column))).select("item_id", F.lit(label).alias("name")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def membership(people: DataFrame, person_labels: DataFrame, label_id: str, name: str) -> DataFrame:
    """item_id, name for items with a contributor that carries the label."""
    has = person_labels.where(F.col("label_id") == label_id).select("contributor_id")
    return people.join(has, "contributor_id", "left_semi").select("item_id", F.lit(name).alias("name")).distinct()


def signalled(items: DataFrame, name: str, sources: list[str], url_parts: list[str], code_pattern: str, file_pattern: str, exempt: list[str]) -> DataFrame:
    """item_id, name for items that any signal marks: source, part of a url, pattern of the code or of the file's name.

    Exempt sources are not marked by the two patterns.  ``items``: source_name, urls array, code, path.
    """
    source = F.lower(F.coalesce("source_name", F.lit("")))
    by_source = source.isin(*[s.lower() for s in sources])
    by_url = F.coalesce(F.exists("urls", lambda u: F.exists(F.lit([p.lower() for p in url_parts]), lambda p: F.contains(F.lower(u), p))), F.lit(False))
    free = ~source.isin(*[s.lower() for s in exempt])
    by_code = free & F.coalesce(F.col("code").rlike("(?U)^(?:" + code_pattern + ")"), F.lit(False))
    by_file = free & F.coalesce(basename(F.col("path")).rlike("(?U)^(?:" + file_pattern + ")"), F.lit(False))
    return items.where(by_source | by_url | by_code | by_file).select("item_id", F.lit(name).alias("name"))


def eras(items: DataFrame, buckets: list[Bucket]) -> DataFrame:
    return items.select("item_id", bucket_of(F.year("item_date"), buckets).alias("name")).where("name IS NOT NULL")


def source_labels(items: DataFrame, prefix: str = "SOURCE:") -> DataFrame:
    named = items.where("trim(coalesce(source_name, '')) <> ''")
    return named.select("item_id", F.concat(F.lit(prefix + " "), "source_name").alias("name"))


def derived(spark: SparkSession, parts: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(labels, issues) of all derivations: item_id, name without repeats; and derivation, item_id, contributor_id, failure.

    A derivation whose plan cannot be made (a column that is not there) is an issue of its own, without item, and does not
    keep the others from their labels.
    """
    labels = spark.range(0).select(F.lit("").alias("item_id"), F.lit("").alias("name"))
    issues = spark.range(0).select(F.lit("").alias("derivation"), F.lit("").alias("item_id"), F.lit("").alias("contributor_id"), F.lit("").alias("failure"))
    for name, make in parts.items():
        try:
            df = make()
            rows = df.select("item_id", "name").where("name IS NOT NULL")
        except AnalysisException as e:
            none = F.lit(None).cast("string")
            issues = issues.unionByName(spark.range(1).select(F.lit(name).alias("derivation"), none.alias("item_id"), none.alias("contributor_id"), F.lit(e.getCondition() or "failed").alias("failure")))
            continue
        labels = labels.unionByName(rows)
        if "failure" in df.columns:
            issues = issues.unionByName(df.where("failure IS NOT NULL").select(F.lit(name).alias("derivation"), "item_id", "contributor_id", "failure"))
    return labels.distinct(), issues
