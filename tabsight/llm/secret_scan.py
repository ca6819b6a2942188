"""Secrets in whole texts: three fixed patterns, and runs of characters of high entropy. DataFrame functions only.

Positions come from cutting the text at the matches: a match starts where the parts and matches before it end. All
positions are code points, ends exclusive.

Entropy: a candidate is a run of characters of one class (hex or base64). A window slides over it; the counts of its
characters and the sum of c*log2(c) change by the one that enters and the one that leaves, and the highest entropy of
any window decides. Prose, identifiers and allow-listed strings are left alone: a candidate must mix letters and digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import own_names, quoted

# The base patterns and the least lengths of their matches.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

#: Candidates by character class, and the least entropy in bits of a window that makes one a secret.
WINDOW = 20
CLASSES = {"entropy_hex": (r"(?<![0-9A-Za-z+/_=-])[0-9A-Fa-f]{20,}(?![0-9A-Za-z+/_=-])", 3.0), "entropy_base64": (r"[0-9A-Za-z+/_=-]{20,}", 3.9)}
#: Strings that look random but are known to be harmless: identifiers in UUID form, runs of digits and signs, paths,
#: names in words, content digests with their algorithm's name.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    r"|^[0-9+/_=-]+$|^[A-Za-z+/_=-]+$|^/?([A-Za-z]+[/_-])+[A-Za-z]*[0-9]*$|^(sha|md)[0-9]+[-_=].*$|(?i)example|placeholder"
)
KINDS = ("assign", "access", "hex", *CLASSES)
#: Elements of an array that are run through at once.
BLOCK = 256
_SPAN = "array<struct<start:bigint,kind_no:int,kind:string,end:bigint>>"


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def _blocks(values: Column) -> Column:
    """An array cut into arrays of ``BLOCK``; an empty one gives none."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    none = F.filter(F.array(values), lambda v: F.lit(False))
    return F.when(F.size(values) > 0, F.transform(numbers, lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(none)


def running(values: Column, join) -> Column:
    """``join`` of all values up to each one, for an array of longs.

    Running results are made in blocks, whose last ones are run through in turn: an array that grows by one value is
    copied for each, so only short ones are grown.
    """

    def scan(own: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        return F.aggregate(own, empty, lambda out, x: F.concat(out, F.array(F.when(F.size(out) > 0, join(F.element_at(out, -1), x)).otherwise(x))))

    def whole(parts: Column) -> Column:
        before = lambda last: F.concat(F.array(F.lit(None).cast("bigint")), last)
        bases = before(scan(F.transform(parts, lambda part: F.element_at(part, -1))))
        return _let(bases, lambda b: F.flatten(F.transform(parts, lambda part, k: F.transform(part, lambda x: F.when(k > 0, join(F.get(b, k), x)).otherwise(x)))))

    return _let(values, lambda own: _let(F.transform(_blocks(own), scan), whole))


def _matches(text: Column, pattern: str, keep) -> Column:
    """(start, end, match) of every leftmost, non-overlapping match that ``keep`` accepts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def spans(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["match"])).cast("long")), lambda a, b: a + b)
        placed = F.zip_with(pairs, ends, lambda p, end: F.struct((end - F.length(p["match"])).alias("start"), end.alias("end"), p["match"].alias("match")))
        return F.filter(placed, lambda s: keep(s["match"]))

    pairs = _let(found, lambda own: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(own)).alias("gap"), own.alias("match")))
    return F.when(text.rlike(pattern), _let(pairs, spans))


def window_entropy(text: Column, width: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits) of any window of ``width`` characters; of the whole, if it is shorter."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return _let(chars, lambda own: _let(F.array_distinct(own), lambda letters: _entropy(own, letters, width)))


def _entropy(chars: Column, letters: Column, width: int) -> Column:
    zero = F.lit(0.0)

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(zero)

    def count(counts: Column, letter: Column) -> Column:
        return F.element_at(counts, F.array_position(letters, letter).cast("int"))

    def changed(counts: Column, letter: Column, by: int) -> Column:
        at = F.array_position(letters, letter) - 1
        return F.transform(counts, lambda n, i: F.when(i == at, n + by).otherwise(n))

    def enter(state: Column, letter: Column) -> Column:
        n = count(state["counts"], letter)
        return F.struct(changed(state["counts"], letter, 1).alias("counts"), (state["sum"] + term(n + 1) - term(n)).alias("sum"), state["least"].alias("least"))

    def leave(state: Column, letter: Column) -> Column:
        n = count(state["counts"], letter)
        return F.struct(changed(state["counts"], letter, -1).alias("counts"), (state["sum"] + term(n - 1) - term(n)).alias("sum"), state["least"].alias("least"))

    def slide(state: Column, pair: Column) -> Column:
        moved = leave(enter(state, pair["new"]), pair["old"])
        return F.struct(moved["counts"].alias("counts"), moved["sum"].alias("sum"), F.least(state["least"], moved["sum"]).alias("least"))

    none = F.transform(letters, lambda _: F.lit(0).cast("double"))
    first = F.aggregate(F.slice(chars, 1, width), F.struct(none.alias("counts"), zero.alias("sum"), zero.alias("least")), enter)
    rest = F.greatest(F.size(chars) - width, F.lit(0))
    pairs = F.arrays_zip(F.slice(chars, F.lit(width + 1), rest).alias("new"), F.slice(chars, F.lit(1), rest).alias("old"))
    begun = F.struct(first["counts"].alias("counts"), first["sum"].alias("sum"), first["sum"].alias("least"))
    size = F.least(F.size(chars), F.lit(width)).cast("double")
    return F.log2(size) - F.aggregate(pairs, begun, slide, lambda s: s["least"]) / size


def _random(match: Column, least: float) -> Column:
    mixed = match.rlike("[0-9]") & match.rlike("[A-Za-z]") & ~match.rlike(ALLOW)
    return mixed & (F.when(mixed, window_entropy(match)) >= least)


def _labelled(spans: Column, kind: str) -> Column:
    made = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.coalesce(made, F.array().cast(_SPAN))


def find_secrets(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """Add the spans (start, kind_no, kind, end) by start, then kind, as the column ``name``.

    Needs ``text``; a null or empty text has none. Every base match stays; an entropy span is added only where no base
    span and no entropy span of an earlier class overlaps it. Repeated rows are scanned alike, an empty table gives an
    empty one. All other columns pass through, whatever their names; one that has the very name is replaced. Work grows
    with the length of a text and the number of its matches, not with their square.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    assign = _matches(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGN_MIN)
    access = _matches(text, ACCESS, lambda m: F.length(m) >= ACCESS_MIN)
    # Only runs that are long enough are taken, from their first character: the same spans as runs filtered by length.
    long_hex = f"(?<![0-9a-f])[0-9a-f]{{{HEX_MIN},}}"
    base = F.concat(
        _labelled(assign, "assign"), _labelled(access, "access"), _labelled(_matches(text, long_hex, lambda m: F.lit(True)), "hex")
    )
    random = [_labelled(_matches(text, p, lambda m, b=bits: _random(m, b)), kind) for kind, (p, bits) in CLASSES.items()]
    # One column of our own holds all that is found.
    (own,) = own_names(docs, "found")
    held = docs.select("*", F.struct(base.alias("base"), *[spans.alias(kind) for kind, spans in zip(CLASSES, random, strict=True)]).alias(own))
    taken = F.col(f"{own}.base")
    for kind in CLASSES:
        taken = _let(taken, lambda t: F.concat(t, _apart(F.col(f"{own}.{kind}"), t)))
    rest = [quoted(c) for c in docs.columns if c.lower() != name.lower()]
    return held.select(*rest, F.array_sort(taken).alias(name))


def _apart(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of the others: by their neighbours in the order of begins."""
    placed = lambda own, free: F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(free).alias("free"), s["end"].alias("end"), s.alias("span")))
    last = F.lit((1 << 62)).cast("long")

    def apart(both: Column) -> Column:
        zero = F.lit(0).cast("long")
        reached = running(F.transform(both, lambda s: F.when(s["free"] == 0, s["end"]).otherwise(zero)), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(both, lambda s: F.when(s["free"] == 0, s["start"]).otherwise(last))), F.least))
        known = F.arrays_zip(both.alias("s"), reached.alias("reached"), ahead.alias("ahead"))
        kept = F.filter(known, lambda k: (k["s"]["free"] == 1) & (k["reached"] <= k["s"]["start"]) & (k["ahead"] >= k["s"]["end"]))
        return F.transform(kept, lambda k: k["s"]["span"])

    either = F.array_sort(F.concat(placed(taken, 0), placed(spans, 1)))
    return F.when((F.size(spans) > 0) & (F.size(taken) > 0), _let(either, apart)).otherwise(spans)


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, the digest of the base spans, and all spans as text; one row a document.

    Only ``doc_id`` and ``text`` are read, so further columns cannot clash; a null text is an empty one.
    """
    found = find_secrets(docs.select("doc_id", "text"))
    spans = F.col("secrets")
    counts = [_count(spans, kind) for kind in KINDS[:3]]
    base = F.filter(spans, lambda s: s["kind_no"] < 3)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def _redacted(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each span (in the order of begins) as a mark; overlapping ones become one.

    A long text is cut into the stretches of some spans each, which are then cut up alone.
    """
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)

    def cut(whole: Column, begin: Column, end: Column) -> Column:
        return F.substring(whole, (begin + 1).cast("int"), (end - begin).cast("int"))

    def pieces(reached: Column) -> Column:
        zero = F.lit(0).cast("long")
        steps = F.transform(spans, lambda s, k: F.struct(F.when(k > 0, F.get(reached, k - 1)).otherwise(zero).alias("at"), s["start"].alias("start"), F.get(reached, k).alias("to")))

        def stretch(own: Column) -> Column:
            base = F.get(own, 0)["at"]
            part = cut(text, base, F.element_at(own, -1)["to"])
            joined = lambda p: F.array_join(F.transform(own, lambda s: F.when(s["start"] >= s["at"], F.concat(cut(p, s["at"] - base, s["start"] - base), F.lit(mark))).otherwise("")), "")
            return _let(part, joined)

        cleaned = F.array_join(F.transform(_blocks(steps), stretch), "")
        return F.concat(cleaned, cut(text, F.element_at(reached, -1), F.length(text).cast("long")))

    return _let(ends, pieces)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replace every span by a mark; overlapping spans become one. Returns the columns of ``docs``, whatever their names;
    texts without secrets, null ones included, stay as they are, and ``n_chars``, where there is one, follows the text."""
    spans, clean = own_names(docs, "spans", "clean")
    changed = F.size(spans) > 0
    found = find_secrets(docs, spans)
    found = found.withColumn(clean, F.when(changed, _let(F.col(spans), lambda own: _redacted(F.col("text"), own, mark))).otherwise(F.col("text")))
    columns = {"text": F.col(clean)} | ({"n_chars": F.length(clean).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*[F.when(changed, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else quoted(c) for c in docs.columns])
