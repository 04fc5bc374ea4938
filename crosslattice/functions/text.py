"""Text of taxonomy nodes, and the ways labels are normalised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks of each description mode, fixed values.
DESCRIPTION_BLOCKS = {
    "name+attributes": ("name", "attributes"),
    "name+disjoint+comment": ("name", "attributes", "disjoint", "comment"),
    "full": ("name", "path", "attributes", "disjoint", "comment"),
}
#: ASCII punctuation that concept texts lose, a fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def label_key(c: Column) -> Column:
    """Lower case, no padding."""
    return F.lower(strip(c))


def collapsed(c: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.regexp_replace(label_key(c), r"\s+", " ")


def tokens(c: Column) -> Column:
    """White-space tokens in lower case; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: t != "")


def safe_id(c: Column) -> Column:
    return F.translate(c, "#. ", "___")


def sweep_key(t: Column) -> Column:
    return F.format_string("%.2f", t)


def pair_key(a: Column, b: Column) -> Column:
    """Names in order of spelling, joined."""
    return F.array_join(F.array_sort(F.array(a, b)), "↔")


def retryable(message: Column) -> Column:
    """Whether an error message tells of a passing fault."""
    return F.lower(message).rlike("429|rate|connection|timeout|timed out")


def _items(attributes: Column, between: str) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(pairs, between)


def _block(head: str, body: Column, there: Column) -> Column:
    return F.when(there, F.concat(F.lit(head), body))


def description(mode: str, name: Column, chain: Column, attributes: Column, disjoint: Column, comment: Column) -> Column:
    """A node's text: ``name_only`` and ``name_path`` bare, other modes as headed blocks; absent blocks are left out."""
    if mode == "name_only":
        return name
    if mode == "name_path":
        return F.array_join(chain, " -> ")
    blocks = {
        "name": F.concat(F.lit("Name: "), name),
        "path": _block("Path: ", F.array_join(chain, " -> "), F.size(chain) > 1),
        "attributes": _block("Attributes: ", _items(attributes, ", "), F.size(F.map_keys(attributes)) > 0),
        "disjoint": _block("Disjoint with: ", F.array_join(disjoint, ", "), F.size(disjoint) > 0),
        "comment": _block("Comment: ", comment, comment != ""),
    }
    if mode not in DESCRIPTION_BLOCKS:
        raise ValueError(f"unknown description mode {mode!r}")
    return F.concat_ws("\n", *[blocks[b] for b in DESCRIPTION_BLOCKS[mode]])


def concept_text(mode: str, name: Column, chain: Column, children: Column, attributes: Column, disjoint: Column, comment: Column) -> Column:
    """A node's text for classifiers: concept, concept-parent or concept-children; lower case without punctuation."""
    blocks = [
        F.concat(F.lit("Name: "), name),
        _block("Attributes: ", _items(attributes, "; "), F.size(F.map_keys(attributes)) > 0),
        _block("Comment: ", comment, comment != ""),
        _block("Disjoint with: ", F.array_join(disjoint, ", "), F.size(disjoint) > 0),
    ]
    if mode == "concept-parent":
        blocks.append(_block("Parent chain: ", F.array_join(chain, " -> "), F.size(chain) > 1))
    elif mode == "concept-children":
        blocks.append(_block("Children: ", F.array_join(children, ", "), F.size(children) > 0))
    elif mode != "concept":
        raise ValueError(f"unknown concept mode {mode!r}")
    return F.translate(F.lower(F.concat_ws("\n", *blocks)), PUNCTUATION, "")


def sample(items: Column, limit: int = 5) -> Column:
    """The first items in order of spelling, with an ellipsis if there are more."""
    head = F.array_join(F.slice(F.array_sort(items), 1, limit), ", ")
    return F.when(F.size(items) > limit, F.concat(head, F.lit(", …"))).otherwise(head)


def synonym_first(name: Column, dictionary: list[tuple[str, str]]) -> Column:
    """The name with all uses of the first dictionary word that occurs in it replaced, whatever its case."""
    out = None
    for word, other in dictionary:
        pattern = rf"(?i)\b\Q{word}\E\b"
        hit, new = name.rlike(pattern), F.regexp_replace(name, pattern, other.replace("\\", "\\\\").replace("$", "\\$"))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return name if out is None else out.otherwise(name)


def model_answers(raw: Column) -> Column:
    """``results`` of a model's JSON answer, code fences taken off; null where it is no JSON."""
    text = F.regexp_replace(F.regexp_replace(raw, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", "")
    v = F.try_parse_json(text)
    return F.try_variant_get(v, "$.results", "array<variant>")
