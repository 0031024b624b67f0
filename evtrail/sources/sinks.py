"""Writing a day, rendering it, and remembering what was answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_day(events: DataFrame, path: str, days: DataFrame) -> int:
    """Overwrites the (owner_id, date) partitions of `days`, each with a marker row, so that a day without
    events differs from one that has not run; returns the rows now there for these days."""
    marker = days.select("owner_id", "date").distinct().withColumn("is_marker", F.lit(True))
    rows = events.withColumn("is_marker", F.lit(False)).unionByName(marker, allowMissingColumns=True)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner_id", "date").parquet(path)
    return events.sparkSession.read.parquet(path).join(days.select("owner_id", "date").distinct(), ["owner_id", "date"], "left_semi").where("not is_marker").count()


def render_day(events: DataFrame) -> DataFrame:
    """(owner_id, date, body): a heading and one block an event, in order of `pos`."""
    block = F.format_string("<!-- event:start -->\n## %s\n- id: %s\n\n%s\n<!-- event:end -->", F.col("title"), F.col("event_id"), F.col("content"))
    rows = events.withColumn("block", block).groupBy("owner_id", "date").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"))
    return rows.select("owner_id", "date", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("date").cast("string")), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).alias("body"))


def input_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def split_memo(df: DataFrame, memo: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(hits with their result, rows still to answer); equal hashes count only with equal inputs."""
    keyed = df.withColumn("fingerprint", input_hash(*columns)).withColumn("input", F.to_json(F.struct(*columns)))
    known = memo.select("fingerprint", "input", "result").dropDuplicates(["fingerprint", "input"])
    return keyed.join(known, ["fingerprint", "input"]), keyed.join(known, ["fingerprint", "input"], "left_anti")


def remember(answered: DataFrame) -> DataFrame:
    return answered.select("fingerprint", "input", "result")


def merge_meta(version: int = 3, edit_types: tuple[str, ...] = ("manual_modified", "manual_unknown"), mark: str = "meta", **columns: Column) -> Column:
    """The metadata line of an event, which chat.parse_merge_meta() reads back: known fields only, lists without repeats, fingerprints in their
    form, texts without internal ids, edit types of the known ones.

    columns: the arrays self_relations, evidence_fingerprints, file_keys, source_report_owners, conversation_fingerprints, source_event_ids
    and source_manual_edit_types, and the texts manual_edit_type and content_fingerprint; a field left out is not written."""
    from evtrail.functions.hashing import is_fingerprint

    from .chat import _IDS

    plain = lambda x: (x != "") & ~x.rlike(_IDS)
    keeps = dict.fromkeys(("evidence_fingerprints", "file_keys", "conversation_fingerprints"), is_fingerprint) | dict.fromkeys(("self_relations", "source_report_owners", "source_event_ids"), plain)
    keeps["source_manual_edit_types"] = lambda x: x.isin(*edit_types)
    fields = [F.lit(version).alias("version")]
    for name, column in columns.items():
        if name in keeps:
            kept = F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.trim(x)), keeps[name])
            fields.append(F.array_distinct(kept).alias(name))
        elif name == "manual_edit_type":
            fields.append(F.when(F.coalesce(column, F.lit("")).isin(*edit_types), column).otherwise("").alias(name))
        elif name == "content_fingerprint":
            fields.append(F.when(is_fingerprint(F.coalesce(column, F.lit(""))), column).alias(name))
        else:
            raise ValueError(f"no such field: {name}")
    return F.concat(F.lit(f"<!-- {mark}: "), F.to_json(F.struct(*fields)), F.lit(" -->"))


def render_documents(events: DataFrame, days: DataFrame, fields: dict[str, str], front: dict[str, Column] | None = None, nothing: str = "_no events_") -> DataFrame:
    """(owner_id, date, body): of each of `days` a document with front matter (date, event_count and `front`, columns of days), a heading and a
    block an event in order of `pos`, which event_blocks(), parse_event_block() and front_matter() read back.

    events: owner_id, date, pos, title, event_id, content, the columns that `fields` names by their label (texts, or arrays, whose values
    are joined) and, if there, meta, a line of merge_meta().  A day without events says so."""
    def shown(c: str) -> Column:
        listed = events.schema[c].dataType.typeName() == "array"
        value = F.array_join(F.array_distinct(F.transform(F.col(c), lambda x: F.trim(x.cast("string")))), "、") if listed else F.col(c).cast("string")
        return F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")

    lines = [F.concat(F.lit(f"- **{label}**: "), shown(c)) for label, c in fields.items()]
    number = F.row_number().over(Window.partitionBy("owner_id", "date").orderBy("pos", "event_id")).cast("string")
    meta = [F.col("meta")] if "meta" in events.columns else []
    head = F.concat(F.lit("### "), number, F.lit(". "), F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    block = F.concat_ws("\n", F.lit("<!-- event:start -->"), *meta, head, F.lit(""), F.concat(F.lit("- id: "), "event_id"), *lines, F.lit(""), F.coalesce("content", F.lit("")), F.lit("<!-- event:end -->"))
    blocks = events.select("owner_id", "date", "pos", "event_id", block.alias("block")).groupBy("owner_id", "date").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id", "block"))).alias("b"))
    at = days.join(blocks, ["owner_id", "date"], "left")
    matter = {"date": F.col("date").cast("string"), "event_count": F.size(F.coalesce("b", F.array().cast(blocks.schema["b"].dataType))).cast("string")} | (front or {})
    top = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{name}: "), c.cast("string")) for name, c in matter.items()), F.lit("---"))
    body = F.when(F.col("b").isNull(), F.lit(nothing)).otherwise(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"))
    return at.select("owner_id", "date", F.concat_ws("\n\n", top, F.concat(F.lit("# "), F.col("date").cast("string")), body).alias("body"))
