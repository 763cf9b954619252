"""Standoff annotations: entity, attribute, relation, event and note lines next to a text.

Files are read as lines, so a long annotation file is split over tasks. Functions that end
in ``_lines`` work on a ``(source, line)`` table from any origin.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.text import drop_extension, empty_to_null, strip_space
from chartloom.operators.lists import number_within

# The line grammar of the format.
ENTITY_LINE = r"^(.\d+)\t([^ ]+) ([^\t]+)\t(.*)$"
T_LINE = r"^(T\d+)\t([^\s]+)([^\t]+)\t(.*)$"
NOTE_LINE = r"^(#\d+)\tAnnotatorNotes ([^\t]+)\t(.*)$"
RELATION_LINE = r"^(R\d+)\t([^\s]+) Arg1:([^\s]+) Arg2:([^\s]+)"
ATTRIBUTE_LINE = r"^([AM]\d+)\t(.+)$"
EVENT_LINE = r"^(E\d+)\t(.+)$"
EVENT_PART = r"([^\s]+):([TE]\d+)"
DRUG_LABEL = "Chemical_and_drugs"


def _below(root: str) -> Column:
    """Path of the file a row comes from, below ``root``: files of one name in two folders stay apart."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substring_index(path, root.rstrip("/").split("://")[-1] + "/", -1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line) of every ``.ann`` file under a folder; ``source`` is the path below it."""
    df = spark.read.text(path, pathGlobFilter="*.ann", recursiveFileLookup=True)
    return df.select(_below(path).alias("source"), F.col("value").alias("line"))


def discover_notes(spark: SparkSession, root: str, exclude: str = "checkpoint") -> DataFrame:
    """(note_id, text) of every ``.txt`` file under ``root``; file names with ``exclude`` are left out.

    The id is the path below ``root`` without its extension.
    """
    df = spark.read.text(root, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
    df = df.select(F.regexp_replace(_below(root), r"\.[^.]*$", "").alias("note_id"), F.col("value").alias("text"))
    return df.where(~F.element_at(F.split("note_id", "/"), -1).contains(exclude))


def _fragments(offsets: Column) -> Column:
    """``1 4;6 9`` to an array of (begin, end)."""
    parts = F.transform(F.split(strip_space(offsets), ";"), lambda s: F.split(strip_space(s), r"\s+"))
    return F.transform(
        parts, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("int").alias("begin"), F.get(p, F.lit(1)).try_cast("int").alias("end"))
    )


def _fragment_texts(term: Column, frags: Column) -> Column:
    """Fragments with their piece of the term, in text order.

    The term lists the pieces in the order of the offsets, one separator apart.
    """

    def piece(f, i):
        before = F.aggregate(
            F.slice(frags, F.lit(1), i), F.lit(0), lambda acc, g: acc + g["end"] - g["begin"] + 1
        )
        text = F.substring(term, before + 1, F.greatest(f["end"] - f["begin"], F.lit(0)))
        return F.struct(f["begin"].alias("begin"), f["end"].alias("end"), text.alias("text"))

    return F.array_sort(F.transform(frags, piece))


def parse_lines(lines: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Entity and comment lines as {ann_id, term, label, source, span}.

    A fragmented entity is reordered by position: its pieces are joined by one space and its
    span becomes ``first begin, last end``. Other lines are skipped.
    """
    line = strip_space("line")
    df = lines.where(line.rlike(ENTITY_LINE)).select(
        "source",
        F.regexp_extract(line, ENTITY_LINE, 1).alias("ann_id"),
        F.regexp_extract(line, ENTITY_LINE, 2).alias("label"),
        F.regexp_extract(line, ENTITY_LINE, 3).alias("span"),
        F.regexp_extract(line, ENTITY_LINE, 4).alias("term"),
    )
    if labels is not None:
        df = df.where(F.col("label").isin(list(labels)))
    split = F.col("span").contains(";")
    pieces = _fragment_texts(F.col("term"), _fragments(F.col("span")))
    df = df.withColumn("_p", F.when(split, pieces))
    return df.select(
        "ann_id",
        F.when(split, F.array_join("_p.text", " ")).otherwise(F.col("term")).alias("term"),
        "label",
        "source",
        F.when(
            split, F.concat_ws(" ", F.element_at("_p.begin", 1).cast("string"), F.element_at("_p.end", -1).cast("string"))
        ).otherwise(F.col("span")).alias("span"),
    )


def read_standoff(spark: SparkSession, path: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Entities of a folder of annotation files, one row per entity line."""
    return parse_lines(read_lines(spark, path), labels)


@dataclass(frozen=True)
class Standoff:
    """Typed tables of an annotation corpus; ``bad_lines`` holds lines outside the grammar."""

    entities: DataFrame
    attributes: DataFrame
    relations: DataFrame
    events: DataFrame
    notes: DataFrame
    bad_lines: DataFrame


def merge_fragments(frags: Column, text: Column | None = None) -> Column:
    """Sorted fragments; with a text, neighbours with only white space between them become one."""
    ordered = F.array_sort(frags)
    if text is None:
        return ordered
    empty = F.slice(ordered, 1, 0)

    def step(acc, f):
        last = F.element_at(acc, -1)
        gap = F.substring(text, last["end"] + 1, F.greatest(f["begin"] - last["end"], F.lit(0)))
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(last["begin"].alias("begin"), f["end"].alias("end"))),
        )
        touching = F.length(strip_space(gap)) == 0
        return F.when(F.size(acc) == 0, F.array(f)).when(touching, joined).otherwise(F.concat(acc, F.array(f)))

    return F.aggregate(ordered, empty, step)


def parse_full(lines: DataFrame, texts: DataFrame | None = None, on_error: str = "quarantine") -> Standoff:
    """All line kinds as typed tables.

    ``texts`` is (source, text); with it, fragments that a line break split are merged.
    ``on_error="raise"`` makes a malformed line an error instead of a ``bad_lines`` row.
    """
    kind = F.substring("line", 1, 1)
    pattern = (
        F.when(kind == "T", F.col("line").rlike(T_LINE))
        .when(kind.isin("A", "M"), F.col("line").rlike(ATTRIBUTE_LINE) & (F.size(F.split("line", " ")) > 1))
        .when(kind == "R", F.col("line").rlike(RELATION_LINE))
        .when(kind == "E", F.col("line").rlike(EVENT_LINE))
        .when(kind == "#", F.col("line").rlike(NOTE_LINE))
    )
    tagged = lines.select("source", "line", kind.alias("kind"), pattern.alias("ok"))
    if on_error == "raise":
        bad = F.concat(F.lit("malformed annotation line in "), F.col("source"), F.lit(": "), F.col("line"))
        tagged = tagged.withColumn("ok", F.when(~F.col("ok"), F.raise_error(bad).cast("boolean")).otherwise(F.col("ok")))
    good = tagged.where("ok")

    def of(k, pattern):
        rows = good.where(F.col("kind").isin(*k))
        return rows, lambda i: F.regexp_extract("line", pattern, i)

    rows, g = of("T", T_LINE)
    entities = rows.select(
        "source", g(1).alias("entity_id"), g(2).alias("label"), g(4).alias("text"), F.array_sort(_fragments(g(3))).alias("fragments")
    )
    if texts is not None:
        many = entities.where(F.size("fragments") > 1).join(
            texts.select("source", F.col("text").alias("_t")), "source", "left"
        )
        merged = F.when(F.col("_t").isNull(), F.col("fragments")).otherwise(
            merge_fragments(F.col("fragments"), F.col("_t"))
        )
        entities = entities.where(F.size("fragments") <= 1).unionByName(
            many.withColumn("fragments", merged).drop("_t")
        )
    rows, g = of("AM", ATTRIBUTE_LINE)
    parts = F.split(g(2), " ")
    attributes = rows.select(
        "source", g(1).alias("attribute_id"), parts[0].alias("label"), F.get(parts, F.lit(1)).alias("target_id"),
        F.get(parts, F.lit(2)).alias("value"),
    )
    rows, g = of("R", RELATION_LINE)
    relations = rows.select(
        "source", g(1).alias("relation_id"), g(2).alias("relation_label"), g(3).alias("from_entity_id"), g(4).alias("to_entity_id")
    )
    rows, g = of("E", EVENT_LINE)
    arguments = F.arrays_zip(
        F.regexp_extract_all(g(2), F.lit(EVENT_PART), F.lit(1)).alias("label"),
        F.regexp_extract_all(g(2), F.lit(EVENT_PART), F.lit(2)).alias("entity_id"),
    )
    events = rows.select("source", g(1).alias("event_id"), arguments.alias("arguments"))
    rows, g = of("#", NOTE_LINE)
    notes = rows.select("source", g(1).alias("comment_id"), g(2).alias("entity_id"), g(3).alias("comment"))
    bad_lines = tagged.where(~F.col("ok")).select("source", "line")
    return Standoff(entities, attributes, relations, events, notes, bad_lines)


def read_standoff_full(
    spark: SparkSession, path: str, merge_spaced: bool = True, on_error: str = "quarantine"
) -> Standoff:
    """Typed tables of a folder of ``.ann`` / ``.txt`` pairs."""
    texts = None
    if merge_spaced:
        df = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True)
        name = F.concat(F.regexp_replace(_below(path), r"\.[^./]*$", ""), F.lit(".ann"))
        texts = df.select(name.alias("source"), F.col("value").alias("text"))
    return parse_full(read_lines(spark, path), texts, on_error)


def notes_and_fragments(entities: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(note_id, note_text) and one row per fragment.

    ``index`` numbers the entities of a note from 0 in the order of their ids (equal ids: by label and text).
    """
    number = F.substring("entity_id", 2, 20).cast("long")
    ids = number_within(entities.withColumn("_n", number), ["source"], "_n", ["label", "text"], "index")
    rows = ids.select(
        drop_extension(F.col("source")).alias("note_id"), (F.col("index") - 1).alias("index"),
        F.explode("fragments").alias("f"), "label", F.col("text").alias("lexical_variant"),
    )
    frags = rows.select("note_id", "index", F.col("f.begin").alias("begin"), F.col("f.end").alias("end"), "label", "lexical_variant")
    return texts.select(drop_extension(F.col("source")).alias("note_id"), F.col("text").alias("note_text")), frags


def _line_pieces(text: Column, begin: Column, end: Column) -> Column:
    """Spans of the lines inside a fragment, without the blanks around line breaks."""
    body = F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))
    lines = F.split(body, "\n")

    def piece(line, i):
        before = F.aggregate(F.slice(lines, F.lit(1), i), F.lit(0), lambda acc, x: acc + F.length(x) + 1)
        left = F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))
        kept = F.when(i == F.size(lines) - 1, line).otherwise(F.regexp_replace(line, " +$", ""))
        lo, hi = begin + before + left, begin + before + F.length(kept)
        return F.struct(lo.cast("int").alias("begin"), F.greatest(hi, lo).cast("int").alias("end"))

    return F.filter(F.transform(lines, piece), lambda s: s["end"] > s["begin"])


def standoff_lines(
    entities: DataFrame, texts: DataFrame, attributes: DataFrame | None = None, attr_label: str = DRUG_LABEL
) -> DataFrame:
    """Annotation lines {note_id, line_no, line} of entities (note_id, entity_id, label, fragments).

    Entities are numbered T1, T2, … per note by position; their fragments are cut at line
    breaks of the note text. Attributes are written for one label, numbered A1, A2, ….
    """
    begin = F.array_min(F.transform("fragments", lambda f: f["begin"]))
    df = entities.withColumn("_begin", begin)
    df = number_within(df, ["note_id"], "_begin", ["label", "entity_id"], "t")
    df = df.join(texts.select("note_id", F.col("text").alias("_t")), "note_id")
    pieces = F.flatten(
        F.transform(F.array_sort("fragments"), lambda f: _line_pieces(F.col("_t"), f["begin"], f["end"]))
    )
    df = df.withColumn("_p", pieces)
    spans = F.array_join(
        F.transform("_p", lambda p: F.concat_ws(" ", p["begin"].cast("string"), p["end"].cast("string"))), ";"
    )
    words = F.array_join(
        F.transform("_p", lambda p: F.substring(F.col("_t"), p["begin"] + 1, p["end"] - p["begin"])), " "
    )
    name = F.concat(F.lit("T"), F.col("t").cast("string"))
    ents = df.select(
        "note_id", "entity_id", "label", "t",
        F.concat(name, F.lit("\t"), F.col("label"), F.lit(" "), spans, F.lit("\t"), words).alias("line"),
    )
    lines = ents.select("note_id", "t", F.lit(0).cast("long").alias("a"), "line")
    if attributes is not None:
        attrs = attributes.select(
            "note_id", "entity_id", F.col("label").alias("a_label"), F.col("value").alias("a_value")
        ).join(ents.where(F.col("label") == attr_label).drop("line", "label"), ["note_id", "entity_id"])
        attrs = number_within(attrs, ["note_id"], "t", ["a_label", "a_value"], "a")
        text = F.concat(
            F.lit("A"), F.col("a").cast("string"), F.lit("\t"), F.col("a_label"), F.lit(" T"), F.col("t").cast("string"),
            F.lit(" "), F.coalesce("a_value", F.lit("None")),
        )
        lines = lines.unionByName(attrs.select("note_id", "t", "a", text.alias("line")))
    # line_no orders lines inside a note: an entity, then its attributes
    return lines.select("note_id", F.col("t").alias("entity_no"), F.col("a").alias("attribute_no"), "line")


def write_standoff(lines: DataFrame, path: str, buckets: int = 64) -> None:
    """Annotation lines as parquet, spread over hash folders of note ids instead of one file per note."""
    bucket = F.pmod(F.xxhash64("note_id"), F.lit(buckets)).cast("int")
    lines.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(path)


def export_files(files: DataFrame, root: str) -> int:
    """(path, content) rows as files below ``root``, for tools that read one file per note; their number.

    Each task writes its own files through the file system that ``root`` names: first whole into a folder of this export,
    then moved to their place. A task that is lost or runs twice leaves no half file there, and the folder goes at the end.
    """
    from pyarrow import fs

    staging = f"_export-{uuid.uuid4().hex}"

    def write(batches):
        system, base = fs.FileSystem.from_uri(root)
        system.create_dir(f"{base}/{staging}")
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                target, part = f"{base}/{path}", f"{base}/{staging}/{uuid.uuid4().hex}"
                system.create_dir(target.rpartition("/")[0])
                with system.open_output_stream(part) as f:
                    f.write(content.encode())
                system.move(part, target)
            yield pdf[["path"]]

    try:
        return files.select("path", "content").mapInPandas(write, "path string").count()
    finally:
        system, base = fs.FileSystem.from_uri(root)
        if system.get_file_info(f"{base}/{staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{staging}")


def write_notes(notes: DataFrame, path: str) -> None:
    """Note texts (disease, note_id, text), one folder per disease."""
    notes.select("disease", "note_id", "text").write.mode("overwrite").partitionBy("disease").parquet(path)


def repair_attributes(lines: DataFrame) -> DataFrame:
    """Attribute lines with their default value added where it is missing."""
    # Attribute name and the value a bare line stands for.
    defaults = (("Negation", "Neg"), ("Allergie", "Allergic"), ("Family", "Relative"))
    line = F.col("line")
    out = F.when(F.lit(False), line)
    for name, value in defaults:
        bare = line.startswith("A") & line.contains(name) & ~line.endswith(" " + value)
        out = out.when(bare, F.concat(F.regexp_replace(line, r"\s+$", ""), F.lit(" " + value)))
    return lines.withColumn("line", out.otherwise(line))


def override_labels(lines: DataFrame) -> DataFrame:
    """Entity labels replaced by the value of an attribute line, which is then dropped.

    One equality join on (source, entity id); attribute lines of unknown entities stay.
    """
    # Entity label and the attribute whose value replaces it.
    rules = {"Tech": DRUG_LABEL, "AttTemp": "Temporal"}
    line = F.col("line")
    rule = F.when(F.lit(False), F.lit(""))
    for name in rules:
        rule = rule.when(line.startswith("A") & line.contains(name), F.lit(name))
    tagged = lines.withColumns(
        {
            "_rule": rule,
            "_id": empty_to_null(F.regexp_extract("line", r"T(\d+)", 1)),
            "_is_t": line.startswith("T"),
        }
    )
    attrs = tagged.where(F.col("_rule").isNotNull())
    per_entity = attrs.groupBy("source", "_id").agg(
        *[
            F.max(F.when(F.col("_rule") == name, F.element_at(F.split(strip_space("line"), r"\s+"), -1))).alias("_" + name)
            for name in rules
        ]
    )
    ents = tagged.where("_is_t").join(per_entity, ["source", "_id"], "left")
    new = F.col("line")
    for name, old in rules.items():
        swap = F.col("_" + name).isNotNull() & new.rlike(rf"^T\d+\t{old} ")
        new = F.when(swap, F.concat(F.substring_index(new, "\t", 1), F.lit("\t"), F.col("_" + name), F.regexp_extract(new, rf"^T\d+\t{old}( .*)$", 1))).otherwise(new)
    known = tagged.where("_is_t").select("source", "_id").distinct()
    orphans = attrs.join(known, ["source", "_id"], "left_anti")
    others = tagged.where(~F.col("_is_t") & F.col("_rule").isNull())
    return (
        ents.withColumn("line", new).select("source", "line")
        .unionByName(others.select("source", "line"))
        .unionByName(orphans.select("source", "line"))
    )


def drop_unannotated(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents (source, …) that have at least one annotation line."""
    return docs.join(lines.where(F.length("line") > 0).select("source").distinct(), "source", "left_semi")
