"""Personal data by pattern, checksum and context, in column functions only.

Patterns propose spans, checks confirm them, and words nearby move the score. Base kinds: e-mail,
IPv4 address, payment card (Luhn) and phone number; the method adds bank account numbers (IBAN,
mod 97). Spans of a kind never overlap; spans of different kinds may. Positions are code points,
end exclusive. A null text has no spans; other columns of the input are kept, whatever their names.

The patterns match the same spans as the plain forms in ``BASE``, but never rescan a run of
characters: possessive repeats, and a start only where a run starts or the last match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Plain forms of the base patterns, as specified.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str        # a text without this pattern has no match: skips the costly one
    context: str     # words that make a match likelier
    prior: float     # score of a confirmed match without context


KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@",
         r"(?i)\b(e-?mail|mail|contact|write|correo|courriel)\b", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".",
         r"(?i)\b(ip|host|server|address|login|client|remote)\b", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "",
         r"(?i)\b(card|visa|credit|debit|payment|tarjeta|karte|carte)\b", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+",
         r"(?i)\b(tel|phone|call|mobile|fax|telefon|t[ée]l[ée]phone)\b", 0.8),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
         r"(?![A-Za-z0-9])", "", r"(?i)\b(iban|bank|account|konto|compte|cuenta)\b", 0.8),
)
BLOCK = 256
NEARBY = 40
CONTEXT_GAIN = 0.15


def _mod97(compact: Column) -> Column:
    """Whether an account number, moved and spelled in digits, leaves 1 modulo 97."""
    moved = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0),
        lambda sofar, c: F.when(c.between("0", "9"), (sofar * 10 + c.cast("int")) % 97)
        .otherwise((sofar * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    length = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.rlike(
            "^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return length.between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return length.between(10, 15)
    if kind == "iban":
        compact = F.regexp_replace(match, " ", "")
        return F.length(compact).between(15, 34) & _mod97(compact)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _placed(pieces: Column, hits: Column) -> Column:
    """(start, end, match, text before, text after) of each hit.

    ``pieces`` is the text split at the hits. Running sums go over blocks, so that a text with
    many hits costs little more than linear work.
    """
    width = lambda step: (F.length(step["left"]) + F.length(step["hit"])).cast("bigint")
    zero = F.lit(0).cast("bigint")
    total = lambda items, of: F.aggregate(items, zero, lambda acc, x: acc + of(x))

    def cut_up(steps: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))

    def inside(block: Column, base: Column) -> Column:
        ends = F.aggregate(
            block, F.array().cast("array<bigint>"), lambda acc, step: F.concat(acc, F.array(
                F.coalesce(F.try_element_at(acc, F.lit(-1)), base) + width(step))))
        return F.zip_with(block, ends, lambda step, end: F.struct(
            (end - F.length(step["hit"])).alias("start"), end.alias("end"),
            step["hit"].alias("match"),
            F.right(step["left"], F.lit(NEARBY)).alias("before"),
            F.left(step["right"], F.lit(NEARBY)).alias("after")))

    def numbered(parts: Column) -> Column:
        blocks, sums = parts["blocks"], parts["sums"]
        return F.flatten(F.transform(blocks, lambda block, i: _let(
            total(F.slice(sums, F.lit(1), i), lambda x: x), lambda base: inside(block, base))))

    steps = _let(pieces, lambda p: F.transform(hits, lambda hit, i: F.struct(
        F.get(p, i).alias("left"), hit.alias("hit"), F.get(p, i + 1).alias("right"))))
    return _let(_let(steps, cut_up), lambda blocks: _let(
        F.struct(blocks.alias("blocks"), F.transform(
            blocks, lambda block: total(block, width)).alias("sums")), numbered))


def spans_of(text: Column, number: int, kind: Kind) -> Column:
    """Confirmed spans of one kind, ordered by start."""
    none = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint,"
                          "match:string,score:double>>")
    near = lambda s: s["before"].rlike(kind.context) | s["after"].rlike(kind.context)

    def found(hits: Column) -> Column:
        placed = _placed(F.split(text, kind.pattern, -1), hits)
        sure = F.filter(placed, lambda s: confirmed(kind.name, s["match"]))
        return F.when(F.size(hits) > 0, F.transform(sure, lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind_no"),
            F.lit(kind.name).alias("kind"), s["end"].alias("end"), s["match"].alias("match"),
            F.when(near(s), F.least(F.lit(1.0), F.lit(kind.prior + CONTEXT_GAIN)))
            .otherwise(F.lit(kind.prior)).alias("score")))).otherwise(none)

    likely = text.contains(kind.hint) if kind.hint else text.rlike("[0-9]")
    return F.when(likely, _let(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), found)).otherwise(none)


def find(df: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """``df`` with a sorted array of confirmed spans, replacing a column of that name."""
    value = F.coalesce(F.col(text), F.lit(""))
    found = [spans_of(value, i, kind) for i, kind in enumerate(KINDS)]
    return df.withColumn(output, F.sort_array(F.concat(*found)))


def redact(df: DataFrame, text: str = "text", spans: str = "pii", output: str = "redacted",
           at_least: float = 0.0) -> DataFrame:
    """Text with each span of at least that score replaced by its kind; of overlapping spans, the
    first (then longest) wins."""
    value = F.coalesce(F.col(text), F.lit(""))
    wanted = F.filter(F.col(spans), lambda s: s["score"] >= at_least)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    walked = F.aggregate(wanted, start, lambda acc, s: F.when(
        s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substr(value, (acc["at"] + 1).cast("int"),
                                          (s["start"] - acc["at"]).cast("int")),
                     F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")))
        .otherwise(acc))
    return df.withColumn(output, F.concat(
        walked["out"], F.substr(value, (walked["at"] + 1).cast("int"))))


def digest(found: DataFrame, key: str = "doc_id", spans: str = "pii") -> DataFrame:
    """Counts and joined positions per row, base kinds and all kinds."""
    joined = lambda keep: F.array_join(F.transform(
        F.filter(F.col(spans), keep), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda name: F.size(F.filter(F.col(spans), lambda s: s["kind"] == name)).cast("bigint")
    return found.select(
        F.col(key), *(count(name).alias(f"n_{name}") for name in BASE),
        F.sha2(joined(lambda s: s["kind_no"] < len(BASE)), 256).alias("base_sha256"),
        joined(lambda s: F.lit(True)).alias("spans"),
        count("iban").alias("n_iban"),
        F.round(F.array_max(F.transform(F.col(spans), lambda s: s["score"])), 2).alias("top_score"))
