"""Rules on the node table. All of them look at one node, so checking a corpus is one projection.

What a rule needs from elsewhere (the parent's tag, the speaker maps before a node) is on the node
row already. Nothing is raised: every violation is a row of the errors table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.functions.text import strip
from cuesheet.functions.timing import parse_seconds
from cuesheet.operators.presets import preset_error

# Which element may stand in which.
ALLOWED_CHILDREN = (
    "production/speaker-map",
    "production/script",
    "production/sound",
    "production/mark",
    "script/script",
    "script/sound",
    "script/mark",
)
# Known elements, elements with timing, elements with one value and its attribute.
KNOWN_TAGS = ("production", "speaker-map", "script", "sound", "mark")
TIMED_TAGS = ("production", "script", "sound", "mark")
VALUE_ATTRIBUTES = {"sound": "ref", "mark": "id"}
BACKENDS = ("vibevoice", "qwen")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def has(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def value_of(attribute: Column, text: Column) -> Column:
    """Value given as an attribute or as text."""
    return F.coalesce(F.nullif(strip(attribute), F.lit("")), F.nullif(text, F.lit("")))


def value_error(label: Column, name: str, attribute: Column, text: Column) -> Column:
    stated = strip(attribute)
    return (
        F.when(stated == "", F.concat(label, F.lit(f" {name} attribute cannot be empty")))
        .when(
            attribute.isNotNull() & (text != "") & (text != stated),
            F.concat(label, F.lit(f" text content must match the {name} attribute when both are present")),
        )
        .when(
            attribute.isNull() & (text == ""),
            F.concat(label, F.lit(f" requires either a {name} attribute or text content")),
        )
    )


def seconds_error(label: Column, name: str, may_be_negative: bool) -> Column:
    raw = attr(name)
    seconds = parse_seconds(raw)
    error = F.when(strip(raw) == "", F.concat(label, F.lit(f" {name} cannot be empty"))).when(
        raw.isNotNull() & seconds.isNull(), F.concat(label, F.lit(f" {name} must be a number of seconds"))
    )
    if not may_be_negative:
        error = error.when(seconds < 0, F.concat(label, F.lit(f" {name} must be non-negative seconds")))
    return error


def backend() -> Column:
    return F.lower(strip(F.coalesce(attr("tts"), F.lit("vibevoice"))))


def location(source: Column, line: Column, col: Column) -> Column:
    """``source:line:col`` as far as known."""
    name = F.coalesce(F.nullif(source, F.lit("")), F.lit("<string>"))
    return (
        F.when(source.isNull() & line.isNull() & col.isNull(), F.lit("<unknown>"))
        .when(line.isNull(), name)
        .when(col.isNull(), F.concat_ws(":", name, line.cast("string")))
        .otherwise(F.concat_ws(":", name, line.cast("string"), col.cast("string")))
    )


def _rules() -> list[tuple[int, str, Column, Column]]:
    """(phase, rule, message or null, label of the node the message names)."""
    tag, parent = F.col("tag"), F.col("parent_tag")
    element = F.col("kind") == "element"
    label = F.concat(F.lit("<"), tag, F.lit(">"))
    parent_label = F.concat(F.lit("<"), parent, F.lit(">"))
    timed = element & tag.isin(*TIMED_TAGS)
    script = element & (tag == "script")
    pair = F.concat_ws("/", parent, tag)
    rules = [
        (0, "root", F.when(element & (F.col("depth") == 0) & (tag != "production"), F.lit("The document root must be <production>")), F.lit(None)),
        (0, "child", F.when(element & parent.isin(*KNOWN_TAGS) & ~pair.isin(*ALLOWED_CHILDREN), F.concat(parent_label, F.lit(" does not allow child element "), label)), parent_label),
        (0, "text", F.when((F.col("kind") == "text") & (parent == "production") & (strip(F.col("text")) != ""), F.lit("<production> does not allow text content")), parent_label),
        (0, "parse", F.when(F.col("kind") == "error", F.col("text")), F.lit(None)),
    ]
    for value_tag, name in VALUE_ATTRIBUTES.items():
        message = value_error(label, name, attr(name), F.col("text"))
        rules.append((1, "value", F.when(element & (tag == value_tag), message), label))
    one_map = F.lit("A <production> may contain only one <speaker-map>")
    needs_map = F.lit("A <script> requires a <speaker-map> to be planned before it")
    rules += [
        (2, "one map", F.when(element & (tag == "speaker-map") & (F.col("maps_before") > 0), one_map), label),
        (2, "map first", F.when(script & (F.col("maps_before") == 0), needs_map), label),
        (2, "preset empty", F.when(script & has("preset") & (strip(attr("preset")) == ""), F.lit("<script> preset attribute cannot be empty")), label),
        (2, "tts", F.when(script & (backend() == ""), F.lit("<script> tts attribute cannot be empty")).when(script & ~backend().isin(*BACKENDS), F.lit("<script> tts must be either 'vibevoice' or 'qwen'")), label),
    ]
    for name in ("pre_margin", "post_margin"):
        message = F.concat(label, F.lit(f" {name} cannot be set on document nodes"))
        rules.append((2, "margin", F.when(timed & has(name), message), label))
    both = F.concat(label, F.lit(" may not specify both length and post_gap"))
    rules.append((2, "length and gap", F.when(timed & has("length") & has("post_gap"), both), label))
    for name, negative in (("pre_gap", True), ("post_gap", True), ("length", False)):
        rules.append((2, name, F.when(timed, seconds_error(label, name, negative)), label))
    stated = F.nullif(strip(attr("preset")), F.lit(""))
    rules.append((3, "preset", F.when(script & stated.isNotNull(), preset_error(stated)), label))
    return rules


def errors(nodes: DataFrame) -> DataFrame:
    """All violations: (doc_id, node_id, phase, rule, message, formatted).

    The lowest (phase, node_id, rule_no) of a document is the one a stop-at-first run reports.
    """
    found = F.array(
        *[
            F.when(
                message.isNotNull(),
                F.struct(
                    F.lit(phase).alias("phase"),
                    F.lit(number).alias("rule_no"),
                    F.lit(rule).alias("rule"),
                    message.alias("message"),
                    label.cast("string").alias("label"),
                ),
            )
            for number, (phase, rule, message, label) in enumerate(_rules())
        ]
    )
    exploded = nodes.select(
        "doc_id", "node_id", "source", "line", "col", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e")
    ).select("doc_id", "node_id", "source", "line", "col", "e.*")
    formatted = F.concat(
        location(F.col("source"), F.col("line"), F.col("col")),
        F.lit(": "),
        F.col("message"),
        F.coalesce(F.concat(F.lit(" "), F.col("label")), F.lit("")),
    )
    return exploded.select("doc_id", "node_id", "phase", "rule_no", "rule", "message", formatted.alias("formatted"))


def located(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Errors (doc_id, node_id, message) with the place and tag of their node in the message, as ``errors`` has them."""
    places = nodes.where("kind = 'element'").select("doc_id", "node_id", "source", "line", "col", "tag")
    joined = found.join(places, ["doc_id", "node_id"], "left")
    label = F.coalesce(F.concat(F.lit(" <"), F.col("tag"), F.lit(">")), F.lit(""))
    place = location(F.col("source"), F.col("line"), F.col("col"))
    return joined.select("doc_id", "node_id", F.concat(place, F.lit(": "), "message", label).alias("message"))


def first_errors(found: DataFrame) -> DataFrame:
    """The error a stop-at-first run would report for each document."""
    order = F.struct("phase", "node_id", "rule_no")
    return found.groupBy("doc_id").agg(
        F.min_by("rule", order).alias("rule"), F.min_by("formatted", order).alias("formatted")
    )


def plan_nodes(nodes: DataFrame) -> DataFrame:
    """Audio elements with parsed timing, value, preset and backend."""
    tag = F.col("tag")
    value = F.coalesce(
        *[F.when(tag == t, value_of(attr(name), F.col("text"))) for t, name in VALUE_ATTRIBUTES.items()]
    )
    seconds = lambda name: parse_seconds(attr(name))
    return nodes.where((F.col("kind") == "element") & tag.isin(*TIMED_TAGS)).select(
        "doc_id",
        "node_id",
        "parent_id",
        "depth",
        "ordinal",
        "tag",
        value.alias("value"),
        F.coalesce(seconds("pre_gap"), F.lit(0.0)).alias("pre_gap"),
        F.coalesce(seconds("post_gap"), F.lit(0.0)).alias("post_gap"),
        seconds("length").alias("length"),
        F.when(tag == "script", F.nullif(strip(attr("preset")), F.lit(""))).alias("preset"),
        F.when(tag == "script", backend()).alias("tts"),
    )


def children_named(nodes: DataFrame, parent_tag: str, tag: str) -> DataFrame:
    """How many children of a tag each parent has; a parent's children come from one document."""
    own = nodes.where((F.col("kind") == "element") & (F.col("tag") == parent_tag)).select("doc_id", "node_id")
    counted = (
        nodes.where((F.col("kind") == "element") & (F.col("parent_tag") == parent_tag) & (F.col("tag") == tag))
        .groupBy("doc_id", F.col("parent_id").alias("node_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return own.join(counted, ["doc_id", "node_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def child_count_errors(nodes: DataFrame, parent_tag: str, tag: str, exactly_one: bool) -> DataFrame:
    """Parents with no child of a tag, or with more than one where only one is allowed."""
    counted = children_named(nodes, parent_tag, tag)
    few = F.lit(f"<{parent_tag}> requires {'one' if exactly_one else 'at least one'} <{tag}> element")
    message = F.when(F.col("n") == 0, few)
    if exactly_one:
        message = message.when(F.col("n") > 1, F.lit(f"<{parent_tag}> may contain only one <{tag}> element"))
    return counted.withColumn("message", message).where("message is not null")
