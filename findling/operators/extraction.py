"""What a model has read off descriptions, brought back to the works: realignment, checks, write-back.

Answers come in batches, in any order and number. They are put to their questions by the text that both repeat, split
to filled, empty and to be asked again, cast to the target's columns, and written back once: the same batch again
changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findling.sources.shards import atomic_write

# The fields of an extraction that count as content, and those that a column of 255 characters holds.
CONTENT = ("title", "author", "date_of_birth", "place_of_birth", "date_of_death", "place_of_death", "dimensions", "dating", "material", "technique", "provenance", "signature", "condition", "literature")
SHORT = ("author", "dating", "material", "technique")
WHOLE = ("dating_start", "dating_end")
NUMBERS = ("dim_width", "dim_height", "dim_width_frame", "dim_height_frame")
LISTS = ("dict_material_name", "dict_technique_name")


def realigned(asked: DataFrame, answers: DataFrame, group: str, text: str, order_asked: str, order_answers: str) -> DataFrame:
    """asked with the columns of its answer and `state`: matched, unanswered, or unasked for an answer that is nobody's.

    Within a group the n-th question of a text takes the n-th answer of that text, texts trimmed and null like empty:
    a join of two multisets. What is left over on either side is kept with nulls on the other.
    """
    place = lambda df, order: df.withColumns({"_t": F.coalesce(F.trim(F.col(text)), F.lit(""))}).withColumn("_n", F.row_number().over(Window.partitionBy(group, "_t").orderBy(order)))
    a = place(asked, order_asked)
    b = place(answers, order_answers)
    other = [c for c in answers.columns if c not in (group, text)]
    b = b.select(F.col(group).alias("_g"), F.col("_t").alias("_u"), F.col("_n").alias("_m"), *(F.col(c).alias(f"_b_{c}") for c in other), F.lit(True).alias("_there"))
    met = a.join(b, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_t") == F.col("_u")) & (F.col("_n") == F.col("_m")), "full")
    state = F.when(F.col("_n").isNull(), "unasked").when(F.col("_there").isNull(), "unanswered").otherwise("matched")
    whole = {group: F.coalesce(group, "_g"), text: F.coalesce("_t", "_u")}
    own = [whole[c].alias(c) if c in whole else F.col(c) for c in asked.columns]
    return met.select(*own, *(F.col(f"_b_{c}").alias(c) for c in other), state.alias("state"))


def text(c: Column) -> Column:
    """Trimmed; null for nothing."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))


def has_payload(fields: tuple[str, ...] = CONTENT) -> Column:
    """Whether any field says something."""
    return F.coalesce(*(text(F.col(f)) for f in fields)).isNotNull()


def was_parsed(marker: str | None = "extraction_parsed", fields: tuple[str, ...] = CONTENT) -> Column:
    """Whether the model's answer was understood: the marker says so; without one, or for null, content does."""
    return F.coalesce(F.col(marker), has_payload(fields)) if marker else has_payload(fields)


def fitted(records: DataFrame, key: str = "id") -> DataFrame:
    """Records as the target takes them: text trimmed and cut at 255 characters where the column ends there, whole numbers towards zero, numbers, lists; what does not fit is null."""

    def column(c: str) -> Column:
        own = F.col(c)
        if c in WHOLE:
            return own.cast("string").try_cast("double").cast("decimal(38,0)").try_cast("int") if records.schema[c].dataType.typeName() != "string" else F.trim(own).try_cast("int")
        if c in NUMBERS:
            return own.cast("string").try_cast("double")
        if c in LISTS:
            return own
        return F.left(text(own), F.lit(255)) if c in SHORT else text(own)

    return records.select(text(F.col(key)).alias(key), *(column(c).alias(c) for c in records.columns if c != key))


def split(records: DataFrame, key: str = "id", marker: str | None = "extraction_parsed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filled, empty, again): understood records with and without content, and those without id or not understood."""
    marker = marker if marker in records.columns else None
    good = F.coalesce(text(F.col(key)).isNotNull() & was_parsed(marker), F.lit(False))
    own = records.drop(marker) if marker else records
    return fitted(own.where(good & has_payload()), key), own.where(good & ~has_payload()).select(text(F.col(key)).alias(key)), own.where(~good)


def written_back(target: DataFrame, filled: DataFrame, empty: DataFrame, key: str = "id", fill: tuple[str, ...] = (), done: str = "is_processed") -> DataFrame:
    """The target after a batch: filled rows' columns overwrite, those in `fill` only where the target has nothing (an empty list is nothing); all rows of the batch are done.

    Of several records of a work the greatest counts, compared column by column. Works that are not in the target are left out.
    """
    columns = [c for c in filled.columns if c != key and c in target.columns]
    one = filled.groupBy(key).agg(F.max(F.struct(*columns)).alias("_new"))
    seen = empty.select(key).distinct().withColumn("_empty", F.lit(True))
    met = target.join(one, key, "left").join(seen, key, "left")

    def column(c: str) -> Column:
        old, new = F.col(c), F.col(f"_new.{c}")
        if c not in fill:
            return F.when(F.col("_new").isNotNull(), new).otherwise(old)
        kind = target.schema[c].dataType.typeName()
        nothing = old.isNull() | (F.size(old) == 0) if kind == "array" else text(old).isNull() if kind == "string" else old.isNull()
        return F.when(F.col("_new").isNotNull() & nothing, new).otherwise(old)

    batch = F.col("_new").isNotNull() | F.col("_empty").isNotNull()
    changed = {c: column(c) for c in columns} | {done: F.when(batch, True).otherwise(F.col(done))}
    return met.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in target.columns))


def batch_writer(path: str, key: str = "id", fill: tuple[str, ...] = (), again: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes extractions back to the table at path, each batch as one replacement; the same batch again leaves it as it is. again: gets what is to be asked again."""

    def write(batch: DataFrame, number: int) -> None:
        filled, empty, rest = split(batch, key)
        target = batch.sparkSession.read.parquet(path)
        atomic_write(written_back(target, filled, empty, key, fill), path)
        if again:
            again(rest, number)

    return write


def rerun(records: DataFrame, resolve: dict[str, Column], overwrite: bool = True) -> DataFrame:
    """records with each column of `resolve` worked out again, or (without overwrite) only where it holds nothing, and `changed`, whether any of them differs from before."""
    nothing = lambda c: F.coalesce(F.size(F.filter(c, lambda x: text(x).isNotNull())) == 0, F.lit(True))
    tidy = lambda c: F.coalesce(F.filter(F.transform(c, text), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    new = {c: v if overwrite else F.when(nothing(F.col(c)), v).otherwise(F.col(c)) for c, v in resolve.items()}
    differs = [~tidy(F.col(c)).eqNullSafe(tidy(v)) for c, v in new.items()]
    flag = differs[0]
    for d in differs[1:]:
        flag = flag | d
    return records.withColumns(new | {"changed": flag})
