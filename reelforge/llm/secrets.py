"""Secret scan: fixed patterns, and a randomness test battery for the rest.

DataFrame operations only.  Matches are found by putting a mark around each
(after the mark itself was replaced in the text by a character that no pattern
tells from it), and cutting the text at the marks; lengths in code points then
give the spans.

Battery: a long run of key characters gets the narrowest encoding that holds it
(hex, upper or lower base 36, base 62, base 64).  Under the hypothesis that its
characters are uniform over that alphabet, three statistics add up to one of
chi-squared: that of the counts of all symbols (of classes of neighbouring symbols
where the run is too short to expect five of each), the squared z-score of the
runs above and below the middle, and that of the serial correlation.  Its p is
taken from the Wilson-Hilferty cube root.  Words and identifiers get a small p
there, secrets a uniform one.
For each encoding and band of lengths, the number of truly random runs is twice
that of runs with p above one half; the least threshold t is taken at which the
expected share of others among the runs with p >= t is within ``discovery``.
Short runs mix more with identifiers and so get a stricter threshold, or none.
The longest part of a run between '/', '_' and '-' is tested too; the run is reported
if either passes, so that a key behind a path is found (together with the path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare

#: Pattern and least length (of the group for assignments).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of 24 or more: shorter runs fail as a whole
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"  # '=' only pads, so that a name before it is apart
ALPHABETS = {
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "heX": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "b36": ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "B36": ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "b62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "b64": ("", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"),
}
#: Lower ends of the length bands, and steps of p in the histogram.
BANDS = (20, 28, 40, 64, 128)
STEPS = 50
#: Symbols expected in each class of the uniformity test, and the fewest classes.
EXPECTED, CLASSES = 5, 4
#: Lengths that one fold adds up; more are added up level by level.
FOLD = 64


def _pieces(pattern: str) -> Column:
    """Between the marks: text, match, text, match, ..., text."""
    plain = F.translate("text", "\u0001", "\u0002")
    return F.split(F.regexp_replace(plain, pattern, "\u0001$0\u0001"), "\u0001", -1)


def _running(values: str, level: int = 0) -> str:
    """SQL for the sums before each of the values (array<int>, not empty).

    A fold copies what it has at each step, so it runs over ``FOLD`` values only;
    the sums of such chunks are added up in the same way: linear on the whole.
    """
    v, c, o, x, i, y, j = (f"{name}{level}" for name in "vcoxiyj")
    fold = lambda of: f"slice(aggregate({of}, array(0), (s, y) -> concat(s, array(element_at(s, -1) + y))), 1, size({of}))"
    if level == 2:
        return fold(values)
    chunks = f"transform(sequence(0, cast(floor((size({v}) - 1) / {FOLD}) as int)), {i} -> slice({v}, {i} * {FOLD} + 1, {FOLD}))"
    sums = f"transform({c}, {y} -> aggregate({y}, 0, (s, z) -> s + z))"
    within = f"flatten(transform({c}, ({x}, {j}) -> transform({fold(x)}, z -> z + {o}[{j}])))"
    return _let(v, values, _let(c, chunks, _let(o, _running(sums, level + 1), within)))


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates a value once for all its uses."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _spans(pieces: str) -> Column:
    """array<struct<start, end, match>> from a column of pieces."""
    at = _running(f"transform({pieces}, p -> length(p))")
    spans = f"transform(sequence(1, size({pieces}) - 2, 2), i -> named_struct('start', at[i], 'end', at[i] + length({pieces}[i]), 'match', {pieces}[i]))"
    return F.expr(f"if(size({pieces}) > 2, {_let('at', at, spans)}, cast(array() as array<struct<start:int,end:int,match:string>>))")


def _battery() -> str:
    """SQL for struct<encoding, p> of a run ``t.match``; null p if not in play.

    A run without a letter or without a digit is a word or a number.
    """
    kind = "'b64'"
    for name, (shape, _) in reversed(ALPHABETS.items()):
        if shape:
            kind = f"if(t.match rlike '{shape}', '{name}', {kind})"
    alphabet = "'" + ALPHABETS["b64"][1] + "'"
    for name, (_, letters) in ALPHABETS.items():
        if name != "b64":
            alphabet = f"if(k = '{name}', '{letters}', {alphabet})"
    # '-' and '_' stand for '+' and '/', '=' only pads.
    plain = "translate(rtrim('=', t.match), '-_=', '+/0')"
    values = f"transform(split(c, ''), x -> locate(x, {alphabet}) - 1)"
    fold = """aggregate(v, named_struct('n', 0D, 'last', -1D, 'runs', 0D, 'serial', 0D),
        (s, x) -> named_struct('n', s.n + 1D, 'last', cast(x as double),
            'runs', s.runs + if(s.last >= 0 and (s.last >= w / 2D) <> (x >= w / 2D), 1D, 0D),
            'serial', s.serial + if(s.last >= 0, (s.last - (w - 1D) / 2D) * (x - (w - 1D) / 2D), 0D)))"""
    counts = f"transform(split({alphabet}, ''), a -> length(c) - length(replace(c, a, '')))"
    low = "cast(ceil(%s * w / b) as int)"
    each = f"power(aggregate(slice(u, {low % 'i'} + 1, {low % '(i + 1)'} - {low % 'i'}), 0, (s, y) -> s + y) - f.n * ({low % '(i + 1)'} - {low % 'i'}) / w, 2) / (f.n * ({low % '(i + 1)'} - {low % 'i'}) / w)"
    chi = f"aggregate(transform(sequence(0, cast(b as int) - 1), i -> {each}), 0D, (s, y) -> s + y)"
    x = f"({chi} + power((f.runs - (f.n - 1) / 2D) / sqrt((f.n - 1) / 4D), 2) + power(f.serial / sqrt((f.n - 1) * power((w * w - 1D) / 12D, 2)), 2))"
    z = "(power(x / (b + 1), 1 / 3D) - (1 - 2 / (9 * (b + 1)))) / sqrt(2 / (9 * (b + 1)))"  # b - 1 degrees of the counts, two more
    tail = "1 / (1 + exp(1.5976 * z + 0.07056 * z * z * z))"  # of the normal distribution, to four places
    classes = f"least(w, greatest({CLASSES}D, floor(f.n / {EXPECTED}D)))"
    body = _let("b", classes, _let("u", counts, _let("x", x, _let("z", z, f"named_struct('encoding', k, 'p', {tail})"))))
    p = _let("k", kind, _let("c", plain, _let("v", values, _let("w", f"cast(length({alphabet}) as double)", _let("f", fold, body)))))
    return f"if(t.match rlike '[0-9]' and t.match rlike '[A-Za-z]' and length(rtrim('=', t.match)) >= 20, {p}, null)"


#: SQL for the longest part of a run ``t`` that is long enough (the first of equals), else null.
PART = """transform(array(array_max(transform(split(t.match, '[/_-]'), (p, i) -> named_struct('n', length(p), 'early', -i, 'p', p)))),
    x -> if(x.n >= 20 and x.n < length(t.match), named_struct('start', t.start + locate(x.p, t.match) - 1, 'end', t.start + locate(x.p, t.match) - 1 + x.n, 'match', x.p), null))[0]"""


def scan(docs: DataFrame, discovery: float = 0.1) -> DataFrame:
    """doc_id, base and random: arrays of struct<start, end, kind, ...>.

    Spans are in code points, the end exclusive.  Null texts count as empty;
    rows may repeat; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select(
        "doc_id",
        _pieces(ASSIGN).alias("_assign"),
        _pieces(ACCESS).alias("_access"),
        _pieces(HEX).alias("_hex"),
        _pieces(RUN).alias("_run"),
    ).select("doc_id", *[_spans(f"_{k}").alias(k) for k in ("assign", "access", "hex", "run")])
    value = F.expr("filter(assign, t -> length(regexp_extract(t.match, r'%s', 2)) >= 6)" % ASSIGN.replace("'", "\\x27"))
    tested = f"if(t is null, null, named_struct('start', t.start, 'end', t.end, 'test', {_battery()}))"
    staged = Scratch(spark, "secrets").put(
        found.select(
            "doc_id",
            value.alias("assign"),
            F.expr("filter(access, t -> length(t.match) >= 20)").alias("access"),
            "hex",
            F.expr(f"filter(transform(run, r -> transform(array(r, {PART.replace('t.', 'r.')}), t -> {tested})), r -> r[0].test is not null or r[1].test is not null)").alias("run"),
        )
    )
    limits = thresholds(staged, discovery)
    def limit(t: Column) -> Column:
        out = F.lit(2.0)
        for (encoding, band), least in limits.items():
            end = BANDS[BANDS.index(band) + 1] if band != BANDS[-1] else 1 << 30
            out = F.when((t["test"]["encoding"] == encoding) & (t["end"] - t["start"]).between(band, end - 1), least).otherwise(out)
        return out

    def named(column: str, kind: str, order: int) -> Column:
        return F.transform(column, lambda t: F.struct(t["start"].alias("start"), F.lit(order).alias("order"), t["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.array_sort(F.concat(named("assign", "assign", 0), named("access", "access", 1), named("hex", "hex", 2)))
    random = F.transform(F.filter("run", lambda r: F.exists(r, lambda t: t["test"]["p"] >= limit(t))), lambda r: r[0])
    return staged.withColumn("_random", random).select("doc_id", base.alias("base"), named("_random", "random", 3).alias("random"))


def thresholds(staged: DataFrame, discovery: float) -> dict[tuple[str, int], float]:
    """Least p per encoding and band; from counts of at most 6 x 5 x 51 cells.

    Runs and their parts count alike.
    """
    size = F.col("t.end") - F.col("t.start")
    band = F.lit(BANDS[0])
    for b in BANDS[1:]:
        band = F.when(size >= b, b).otherwise(band)
    runs = staged.select(F.explode(F.flatten("run")).alias("t")).filter("t.test is not null")
    cells = runs.groupBy(F.col("t.test.encoding").alias("encoding"), band.alias("band"), F.floor(F.col("t.test.p") * STEPS).cast("int").alias("step")).agg(F.count("*").alias("n"))
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in cells.collect():
        counts.setdefault((r["encoding"], r["band"]), {})[r["step"]] = r["n"]
    out = {}
    for key, by in counts.items():
        random = 2 * sum(n for step, n in by.items() if step >= STEPS // 2)
        for step in range(1, STEPS):
            at = step / STEPS
            passed = sum(n for s, n in by.items() if s >= step)
            if passed and random and 1 - min(1.0, random * (1 - at) / passed) <= discovery:
                out[key] = at
                break
    return out


def text_of(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda t: F.concat_ws(":", t["kind"], t["start"].cast("string"), t["end"].cast("string"))), ",")
