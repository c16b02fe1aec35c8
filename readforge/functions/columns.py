"""Column expressions for sequences, qualities, CIGAR strings and flags. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- strings


def split_exactly(text: Column, sep: str, n: int) -> Column:
    """``n`` tokens with the remainder in the last; an error if there are fewer."""
    parts = F.split(text, _quoted(sep), n)
    return F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit("too few tokens in: "), text)).cast("array<string>"))


def split_nonempty(text: Column, sep: str, most: int | None = None) -> Column:
    parts = F.filter(F.split(text, _quoted(sep)), lambda x: x != "")
    return parts if most is None else F.slice(parts, 1, most)


def after_first(text: Column, sep: str) -> Column:
    """What follows the first ``sep``; empty if there is none."""
    at = F.instr(text, sep)
    return F.when(at > 0, F.substring(text, at + len(sep), F.length(text))).otherwise(F.lit(""))


def around_first(text: Column, sep: str) -> Column:
    """(before, after) of the first ``sep``; an error if there is none."""
    parts = F.split(text, _quoted(sep), 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("before"), parts[1].alias("after"))).otherwise(F.raise_error(F.lit("separator not found")).cast("struct<before:string,after:string>"))


def split_protected(text: Column, sep: str = ",") -> Column:
    """Split at ``sep`` outside parentheses; an error if these don't balance.

    A fold over the characters carries the depth and the pieces so far.
    """
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
        depth = F.when(depth < 0, F.raise_error(F.lit("parentheses don't balance")).cast("int")).otherwise(depth)
        last = F.concat(F.element_at(acc["parts"], -1), ch)
        joined = F.concat(F.slice(acc["parts"], 1, F.size(acc["parts"]) - 1), F.array(last))
        return F.struct(depth.alias("depth"), F.when((ch == sep) & (acc["depth"] == 0), F.concat(acc["parts"], F.array(F.lit("")))).otherwise(joined).alias("parts"))

    def done(acc: Column) -> Column:
        return F.when(acc["depth"] == 0, acc["parts"]).otherwise(F.raise_error(F.lit("parentheses don't balance")).cast("array<string>"))

    return F.aggregate(F.split(text, ""), start, step, done)


def mixed_case(text: Column) -> Column:
    """First letter in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def one_of_ignoring_case(text: Column, known: list[str]) -> Column:
    return F.lower(text).isin([x.lower() for x in known])


def checked(text: Column, pattern: str) -> Column:
    """``text`` if it matches as a whole, else an error."""
    return F.when(text.rlike(f"^(?:{pattern})$"), text).otherwise(F.raise_error(F.concat(F.lit("not valid: "), text)))


def _quoted(sep: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in sep)


# ---- sequences

#: Bases and their complements; other signs become the character 127.
BASES, COMPLEMENTS = "ACGTacgt", "TGCAtgca"


def complement(seq: Column) -> Column:
    return F.translate(F.regexp_replace(seq, r"[^ACGTacgtNnMm\-]", "\x7f"), BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length ``k`` in order, by matches without width: one pass, however long the sequence."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def find_all(seq: Column, pattern: str, start: int = 0, ignore_case: bool = False) -> Column:
    """0-based places where ``pattern`` occurs, overlaps included, from ``start`` on."""
    own, other = (F.upper(seq), pattern.upper()) if ignore_case else (seq, pattern)
    at = F.transform(kmers(own, len(other)), lambda x, i: F.when((x == other) & (i >= start), i))
    return F.array_compact(at)


def homopolymer(seq: Column, start: Column) -> Column:
    """The run of one base that begins right after the 0-based ``start``."""
    return F.regexp_extract(F.substring(seq, start + 2, F.length(seq)), r"^(.)\1*", 0)


def section(seq: Column, start: Column, end: Column) -> Column:
    """0-based ``start`` to ``end`` inclusive; if ``end`` isn't larger, round the circle and ``end`` exclusive."""
    return F.when(end > start, F.substring(seq, start + 1, end - start + 1)).otherwise(F.concat(F.substring(seq, start + 1, F.length(seq)), F.substring(seq, F.lit(1), end)))


def percent_identity(a: Column, b: Column) -> Column:
    """Share of equal positions that are not gaps, over all positions; lengths must agree."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ((x == y) & (x != "-")).cast("int"))
    same = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), same / F.length(a)).otherwise(F.raise_error(F.lit("lengths differ")).cast("double"))


# ---- mutations: struct<type, start, end, bases>, applied from the last position to the first


def apply_mutation(seq: Column, kind: Column, start: Column, end: Column, bases: Column) -> Column:
    """Insert before ``start``, delete or substitute ``[start, end)``."""
    upto = F.when(kind == "INS", start).otherwise(end)
    return F.concat(F.substring(seq, F.lit(1), start), F.when(kind == "DEL", F.lit("")).otherwise(bases), F.substring(seq, upto + 1, F.length(seq)))


def apply_mutations(seq: Column, mutations: Column) -> Column:
    """Apply an array of mutations given in template positions."""
    rank = lambda m: F.when(m["kind"] == "INS", 0).when(m["kind"] == "DEL", 1).otherwise(2)
    ordered = F.reverse(F.array_sort(F.transform(mutations, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), rank(m).alias("rank"), m["bases"].alias("bases"), m["kind"].alias("kind")))))
    return F.aggregate(ordered, seq, lambda s, m: apply_mutation(s, m["kind"], m["start"], m["end"], m["bases"]))


def length_difference(kind: Column, start: Column, end: Column, bases: Column) -> Column:
    return F.when(kind == "INS", F.length(bases)).when(kind == "DEL", start - end).otherwise(F.lit(0))


def strand_converted(start: Column, kind: Column, length: Column) -> Column:
    """A mutation's position on the other strand."""
    return F.when(kind == "INS", length - start).otherwise(length - start - 1)


# ---- qualities


def phred_to_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def error_to_phred(p: Column) -> Column:
    return -10 * F.log10(p)


def decode_quality(text: Column, offset: int = 33) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - offset)


def trim_tail(q: Column, least: int = 20) -> Column:
    """Qualities up to the last one that is at least ``least``."""
    last = F.array_max(F.transform(q, lambda x, i: F.when(x >= least, i + 1).otherwise(0)))
    return F.slice(q, 1, F.coalesce(last, F.lit(0)))


def array_mean(a: Column) -> Column:
    """Mean of an array; NaN if it is null or empty."""
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(F.lit(float("nan")))


def array_statistics(a: Column) -> Column:
    nan = F.lit(float("nan"))
    some = F.size(a) > 0
    return F.struct(F.when(some, F.array_max(a).cast("double")).otherwise(nan).alias("max"), F.when(some, F.array_min(a).cast("double")).otherwise(nan).alias("min"), array_mean(a).alias("mean"))


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(x))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)); minus infinity on both sides stays that."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(high == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def binomial_survival(q: Column, n: Column, p: float) -> Column:
    """P[X > q] for a binomial X of ``n`` tries: the terms are added up, each made from the one before."""
    state = F.struct(F.pow(F.lit(1 - p), n).alias("term"), F.lit(0.0).alias("sum"))
    odds = p / (1 - p)

    def step(s: Column, k: Column) -> Column:
        return F.struct((s["term"] * (n - k) / (k + 1) * odds).alias("term"), (s["sum"] + F.when(k > q, s["term"]).otherwise(0.0)).alias("sum"))

    return F.when(q < 0, 1.0).when(q >= n, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), n.cast("long")), state, step, lambda s: s["sum"]))


# ---- CIGAR, flags, offsets

CIGAR_OPS = "MIDNSHP=X"


def parse_cigar(cigar: Column) -> Column:
    """array<struct<len, op>>; ``*`` and empty give no element."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(rf"(\d+)([{CIGAR_OPS}])"), 0), lambda t: F.struct(F.regexp_extract(t, r"^\d+", 0).cast("int").alias("len"), F.right(t, F.lit(1)).alias("op")))


def build_cigar(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: F.concat(e["len"].cast("string"), e["op"])), "")


def reference_length(elements: Column) -> Column:
    """Bases of the reference that M, D, N, = and X consume."""
    return F.aggregate(F.filter(elements, lambda e: e["op"].isin("M", "D", "N", "=", "X")), F.lit(0), lambda s, e: s + e["len"])


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def pack_offset(block: Column, inside: Column) -> Column:
    return F.shiftleft(block.cast("long"), 16).bitwiseOR(inside.cast("long"))


def unpack_offset(offset: Column) -> Column:
    return F.struct(F.shiftright(offset, 16).alias("block"), offset.bitwiseAND(F.lit(0xFFFF)).alias("inside"))


# ---- names

CCS_NAME = r"^([^/]+)/(\d+)/ccs$"
SUBREAD_NAME = r"^([^/]+)/(\d+)/(\d+)_(\d+) RQ=([0-9.]+)$"


def parse_ccs_name(name: Column) -> Column:
    return F.struct(F.regexp_extract(name, CCS_NAME, 1).alias("movie"), F.regexp_extract(name, CCS_NAME, 2).cast("int").alias("zmw"))


def parse_subread_name(name: Column) -> Column:
    part = lambda i: F.regexp_extract(name, SUBREAD_NAME, i)
    return F.struct(part(1).alias("movie"), part(2).cast("int").alias("zmw"), part(3).cast("int").alias("start"), part(4).cast("int").alias("end"), part(5).cast("float").alias("rq"))
