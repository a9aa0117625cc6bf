"""Production documents: reading, shredding to a node table, speaker maps."""

from __future__ import annotations

import textwrap
import xml.sax
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cuesheet.functions import text as T
from cuesheet.session import stored

NODE_SCHEMA = (
    "node_id int, parent_id int, ordinal int, depth int, kind string, tag string, parent_tag string, "
    "attrs map<string,string>, text string, maps_before int, line int, col int, end_line int, end_col int"
)
NODE_ROWS = 20_000
# Elements that may hold text.
TEXT_TAGS = ("speaker-map", "script", "sound", "mark")
# Elements whose whole text is one value.
VALUE_TAGS = ("speaker-map", "sound", "mark")


def read_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per file: (doc_id, source, xml)."""
    files = spark.read.text(pattern, wholetext=True)
    return files.select(
        F.input_file_name().alias("doc_id"), F.input_file_name().alias("source"), F.col("value").alias("xml")
    )


class _Shredder(xml.sax.handler.ContentHandler):
    """Turns one document into node rows in document order; text between two tags is one node."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.run: dict | None = None
        self.maps = 0
        self.where = None

    def setDocumentLocator(self, locator) -> None:  # noqa: N802
        self.where = locator

    def _here(self) -> tuple[int, int]:
        return self.where.getLineNumber(), self.where.getColumnNumber() + 1

    def _add(self, kind: str, tag: str | None, attrs: dict, text: str) -> dict:
        parent = self.open[-1] if self.open else None
        line, col = self._here()
        row = {
            "node_id": len(self.rows),
            "parent_id": parent["node_id"] if parent else None,
            "ordinal": parent["children"] if parent else 0,
            "depth": len(self.open),
            "kind": kind,
            "tag": tag,
            "parent_tag": parent["tag"] if parent else None,
            "attrs": attrs,
            "text": text,
            "maps_before": self.maps,
            "line": line,
            "col": col,
            "end_line": None,
            "end_col": None,
            "children": 0,
        }
        if parent:
            parent["children"] += 1
        self.rows.append(row)
        return row

    def startElement(self, name, attrs) -> None:  # noqa: N802
        self.run = None
        row = self._add("element", name, dict(attrs.items()), "")
        if name == "speaker-map":
            self.maps += 1
        self.open.append(row)

    def characters(self, content) -> None:
        if self.run is None:
            self.run = self._add("text", None, {}, "")
            self.run |= {"visible": False, "pieces": []}
        # The place of a text is that of its first visible part.
        if not self.run["visible"] and content.strip():
            self.run["line"], self.run["col"] = self._here()
            self.run["visible"] = True
        self.run["pieces"].append(content)

    def endElement(self, name) -> None:  # noqa: N802
        self.run = None
        row = self.open.pop()
        row["end_line"], row["end_col"] = self._here()


def _shred_text(xml_text: str) -> list[dict]:
    handler = _Shredder()
    rows = handler.rows
    try:
        xml.sax.parseString(xml_text, handler)
    except xml.sax.SAXParseException as problem:
        rows.append(
            {
                "node_id": len(rows), "parent_id": None, "ordinal": 0, "depth": 0, "kind": "error",
                "tag": None, "parent_tag": None, "attrs": {}, "text": problem.getMessage(),
                "maps_before": handler.maps, "line": problem.getLineNumber(), "col": problem.getColumnNumber() + 1,
                "end_line": None, "end_col": None,
            }
        )
    parts: dict[int, list[str]] = {}
    for row in rows:
        if row["kind"] == "text":
            row["text"] = "".join(row.pop("pieces"))
            parts.setdefault(row["parent_id"], []).append(row["text"])
    for row in rows:
        if row["kind"] == "element" and row["tag"] in VALUE_TAGS:
            row["text"] = textwrap.dedent("".join(parts.get(row["node_id"], []))).strip()
    return rows


def shred(documents: DataFrame) -> DataFrame:
    """Node table of a corpus of documents (doc_id, source, xml).

    Broken documents yield the nodes before the break and one row of kind ``error``. A document is
    one row, so this is a map over rows without any shuffle.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    names = [part.strip().split(" ")[0] for part in NODE_SCHEMA.split(", ")]

    def frame_of(found: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(found, columns=["doc_id", "source", *names])
        for name in ("node_id", "parent_id", "ordinal", "depth", "maps_before", "line", "col", "end_line", "end_col"):
            frame[name] = frame[name].astype("Int32")
        return frame

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple] = []
            for doc_id, source, text in zip(batch["doc_id"], batch["source"], batch["xml"]):
                found.extend((doc_id, source, *[row[name] for name in names]) for row in _shred_text(text))
                # Nodes of a few documents at a time, however many documents a batch has.
                if len(found) >= NODE_ROWS:
                    yield frame_of(found)
                    found = []
            if found:
                yield frame_of(found)

    return documents.select("doc_id", "source", "xml").mapInPandas(
        run, f"doc_id {id_type}, source string, {NODE_SCHEMA}"
    )


def speaker_entries(nodes: DataFrame) -> DataFrame:
    """Entries of the speaker maps: one row each, or one row with a problem.

    Output: doc_id, node_id, entry_no, speaker, voice, problem.
    """
    maps = nodes.where((F.col("kind") == "element") & (F.col("tag") == "speaker-map")).select(
        "doc_id", "node_id", "text"
    )
    id_type = maps.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml
        except ImportError as missing:  # pragma: no cover
            raise RuntimeError("Reading speaker maps needs PyYAML on the executors") from missing
        for batch in batches:
            found = []
            for doc_id, node_id, text in zip(batch["doc_id"], batch["node_id"], batch["text"]):
                for entry in _entries(yaml, text):
                    found.append((doc_id, node_id, *entry))
            yield pd.DataFrame(found, columns=["doc_id", "node_id", "entry_no", "speaker", "voice", "problem"])

    return maps.mapInPandas(
        run, f"doc_id {id_type}, node_id int, entry_no int, speaker string, voice string, problem string"
    )


def _entries(yaml, text: str) -> list[tuple]:
    try:
        loaded = yaml.safe_load(text)
    except yaml.YAMLError:
        return [(0, None, None, "unreadable")]
    if not isinstance(loaded, dict):
        return [(0, None, None, "not a mapping")]
    if not loaded:
        return [(0, None, None, "empty")]
    rows = []
    for number, (speaker, voice) in enumerate(loaded.items()):
        if not isinstance(speaker, str) or not isinstance(voice, str):
            rows.append((number, str(speaker), str(voice), "not strings"))
        elif not speaker.strip() or not voice.strip():
            rows.append((number, speaker, voice, "blank"))
        else:
            rows.append((number, speaker.strip(), voice.strip(), None))
    return rows


def speakers(entries: DataFrame) -> DataFrame:
    """Valid entries: (doc_id, node_id, speaker_key, authored_name, voice_name), the first of equal keys."""
    keyed = entries.where("problem is null").withColumn("speaker_key", T.speaker_key(F.col("speaker")))
    return keyed.groupBy("doc_id", "node_id", "speaker_key").agg(
        F.min_by("speaker", "entry_no").alias("authored_name"), F.min_by("voice", "entry_no").alias("voice_name")
    )


def speaker_errors(entries: DataFrame) -> DataFrame:
    """Broken speaker maps and entries: (doc_id, node_id, rule, message)."""
    # Two kinds of errors are read from them, and maps are parsed in Python.
    entries = stored(entries, "speaker_entries")
    # Messages.
    message = (
        F.when(F.col("problem") == "empty", "The <speaker-map> did not define any speakers")
        .when(F.col("problem") == "not strings", "Speaker names and voice names in <speaker-map> must be strings")
        .when(F.col("problem") == "blank", "Speaker names and voice names in <speaker-map> cannot be empty")
        .otherwise("The <speaker-map> YAML must be a mapping of speaker names to voice names")
    )
    broken = entries.where("problem is not null").select(
        "doc_id", "node_id", F.lit("speaker-map entry").alias("rule"), message.alias("message")
    )
    doubled = (
        entries.where("problem is null")
        .groupBy("doc_id", "node_id", T.speaker_key(F.col("speaker")).alias("speaker_key"))
        .agg(F.count(F.lit(1)).alias("n"), F.max_by("speaker", "entry_no").alias("speaker"))
        .where("n > 1")
        .select(
            "doc_id",
            "node_id",
            F.lit("speaker twice").alias("rule"),
            F.concat(F.lit("Speaker '"), "speaker", F.lit("' is defined more than once in <speaker-map>")).alias("message"),
        )
    )
    return broken.unionByName(doubled)
