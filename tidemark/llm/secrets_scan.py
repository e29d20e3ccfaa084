"""Secret scans by patterns and a battery of randomness tests.  DataFrame functions only.

Patterns give the base spans: assignments to telling names, access keys and long hex runs.
Beyond them every run of at least ``LEAST`` letters of an encoding is a candidate.  Its encoding
is inferred from the letters it uses; then

* a chi-squared test of the alphabet's uniformity,
* a runs test of upper against lower half of the alphabet,
* a runs test of the classes of letters (lower, upper, digit, other), and
* a test of the correlation of neighbouring letters

must all be consistent with random letters.  Against natural words speak a chi-squared statistic
below theirs and changes of class more frequent than theirs; both, as standard deviations, add up
(divided by the root of two) to a p-value that the Benjamini-Hochberg procedure must accept.  That
procedure runs over all candidates of the table, in narrow strata of length (a quarter of an octave
each), on a histogram of p-values of bounded size; a short candidate competes with short ones only.
Left alone are candidates without any digit (3, 1.5 and 0.4 % of random base62 tokens of 20, 24 and
32 letters) and those spelt as paths and names in camel case are: words of lower letters after at
most one upper, and numbers only at the end of a part (under 0.1 %).

Positions count code points, ends are exclusive.  Nulls: a null text is empty; a null id stays
null.  Equal rows get equal results; an empty table gives an empty result; other columns stay
unread.  Ties of start are in the order of KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds of spans in their order, and the base patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST = 20
NAME = "^(?:[A-Z]?+[a-z]++|[+/_-]|[0-9]++(?=[+/_-]|$))++$"
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST},}}"
#: Alphabets by encoding, by how much natural words exceed the uniform chi-squared statistic for each letter, and how often they change the class of letters.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", "0123456789abcdef", 1.6, 0.2),
    "HEX": ("^[0-9A-F]+$", "0123456789ABCDEF", 1.6, 0.2),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1, 0.1),
    "base36": ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.3, 0.15),
    "base62": ("^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.0, 0.3),
    "base64": ("", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", 3.1, 0.3),
}
#: Strata of length: so many for each doubling, and the last one open.
BANDS_PER_OCTAVE, LAST_BAND = 4, 24


SPANS = "array<struct<start:int,end:int,kind:string,body:string>>"


def _positions(text: str, pattern: str, kind: str, keep: str = "true") -> Column:
    """``SPANS`` of a pattern's matches: matches and the gaps between them alternate, so lengths add up to positions.

    ``keep`` is SQL over ``x.g``, ``x.h`` and ``x.t``: a gap, the match after it and the match's second group.
    """
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    hits = f"regexp_extract_all({text}, {p}, 0)"
    second = f"regexp_extract_all({text}, {p}, 2)" if "x.t" in keep else hits
    start = "a.at + length(x.g)"
    end = f"{start} + length(x.h)"
    grown = f"IF({keep}, concat(a.spans, array(named_struct('start', {start}, 'end', {end}, 'kind', '{kind}', 'body', x.h))), a.spans)"
    rows = f"filter(zip_with(split({text}, {p}, -1), zip_with({hits}, {second}, (h, t) -> struct(h, t)), (g, m) -> struct(g, m.h AS h, m.t AS t)), x -> x.h IS NOT NULL)"
    return F.expr(f"aggregate({rows}, named_struct('at', 0, 'spans', cast(array() AS {SPANS})), (a, x) -> named_struct('at', {end}, 'spans', {grown})).spans")


def _tested(cands: Column) -> Column:
    """Adds the battery's results to candidates: ``random``, and the natural-word p-value as decibels in a length band."""

    def by_encoding(t: Column, f) -> Column:
        """``f(alphabet, excess, changes)`` of the first encoding whose letters ``t`` keeps to."""
        chain = F
        for pattern, *of in ENCODINGS.values():
            chain = chain.when(t.rlike(pattern), f(*of)) if pattern else chain.otherwise(f(*of))
        return chain

    def random_changes(alphabet: str) -> float:
        """How often neighbouring random letters differ in class."""
        sizes = (sum(map(str.islower, alphabet)), sum(map(str.isupper, alphabet)), sum(map(str.isdigit, alphabet)), sum(not c.isalnum() for c in alphabet))
        return 1 - sum((x / len(alphabet)) ** 2 for x in sizes)

    def coded(x: Column) -> Column:
        t = F.translate(x["body"], "-_", "+/")
        n = F.length(t).cast("double")

        def squares(alphabet: str, *_) -> Column:
            return F.aggregate(F.split(F.lit(alphabet), ""), F.lit(0.0), lambda a, c: a + F.pow(F.length(t) - F.length(F.replace(t, c, F.lit(""))), F.lit(2.0)))

        def halves(alphabet: str, *_) -> Column:
            return F.translate(t, alphabet, "0" * (len(alphabet) // 2) + "1" * (len(alphabet) - len(alphabet) // 2))

        def codes(alphabet: str, *_) -> Column:
            return F.transform(F.split(t, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))

        made = {"squares": squares, "bits": halves, "codes": codes, "k": lambda a, *_: F.lit(float(len(a))), "excess": lambda _, e, __: F.lit(e), "usual": lambda _, __, q: F.lit(q), "wild": lambda a, *_: F.lit(random_changes(a))}
        changes = (F.length(F.regexp_replace(t, "([a-z]++|[A-Z]++|[0-9]++|[+/]++)", "r")) - 1).cast("double")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["body"].alias("body"), n.alias("n"), changes.alias("changes"), *(by_encoding(t, f).alias(k) for k, f in made.items()))

    def centred(x: Column) -> Column:  # on its own, so that the lambdas of moments() read a field and not a sum
        mean = F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + c) / x["n"]
        return F.struct(*(x[c].alias(c) for c in ("start", "end", "body", "n", "changes", "squares", "bits", "codes", "k", "excess", "usual", "wild")), mean.alias("mean"))

    def moments(x: Column) -> Column:
        n1 = F.length(F.replace(x["bits"], F.lit("0"), F.lit(""))).cast("double")
        runs = F.length(F.regexp_replace(x["bits"], r"(0++|1++)", "r")).cast("double")
        mean, size = x["mean"], x["n"].cast("int")
        var = F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
        cov = F.aggregate(F.zip_with(F.slice(x["codes"], F.lit(1), size - 1), F.slice(x["codes"], F.lit(2), size - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, c: a + c)
        kept = (x[c].alias(c) for c in ("start", "end", "body", "n", "changes", "k", "excess", "usual", "wild"))
        return F.struct(*kept, (x["k"] / x["n"] * x["squares"] - x["n"]).alias("chi"), n1.alias("n1"), runs.alias("runs"), F.when(var > 0, cov / var).otherwise(1.0).alias("r"))

    def judged(x: Column) -> Column:
        n, n1, df = x["n"], x["n1"], x["k"] - 1
        mu = 2 * n1 * (n - n1) / n + 1
        sd = F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))
        z_runs = F.abs(x["runs"] - mu) / sd
        z_serial = F.abs(x["r"] + 1 / n) * F.sqrt(n)
        z_chi = (F.pow(x["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        z_class = (x["wild"] * (n - 1) - x["changes"]) / F.sqrt(x["wild"] * (1 - x["wild"]) * (n - 1))
        uniform = (df + n * x["excess"] - x["chi"]) / F.sqrt(2 * df + 4 * n * x["excess"])  # standard deviations below natural words
        restless = (x["changes"] - x["usual"] * (n - 1)) / F.sqrt(x["usual"] * (1 - x["usual"]) * (n - 1))  # and above them
        natural = (uniform + restless) / 2**0.5
        u = F.greatest(natural, F.lit(0.0))
        decibel = -10 * (F.log10(F.lit(0.7979)) - u * u / 2 / F.log(F.lit(10.0)) - F.log10(u + F.sqrt(u * u + 2.546)))  # of the normal tail
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit("random").alias("kind"), x["body"].alias("body"), ((z_runs < 3.5) & (z_serial < 3.5) & (z_chi < 3.5) & (z_class < 3.5) & x["body"].rlike("[0-9]") & ~x["body"].rlike(NAME)).alias("random"),
            F.least(F.floor(F.greatest(decibel, F.lit(0.0))), F.lit(400)).cast("int").alias("decibel"), F.least(F.floor(BANDS_PER_OCTAVE * F.log2(n / LEAST)), F.lit(LAST_BAND)).cast("int").alias("band"),
        )

    return F.transform(F.transform(F.transform(F.transform(cands, coded), centred), moments), judged)


def _found() -> tuple[Column, Column]:
    """The base spans and the tested candidates of each row, from its column ``text_``; cheap tests spare most rows the patterns."""
    text, none = F.col("text_"), F.expr(f"cast(array() AS {SPANS})")
    low = F.lower(text)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = F.when(named, _positions("text_", ASSIGN, "assign", "length(x.t) >= 6")).otherwise(none)
    access = F.when(text.contains("AKIA"), _positions("text_", ACCESS, "access")).otherwise(none)
    hexes = F.when(text.rlike(HEX), _positions("text_", HEX, "hex")).otherwise(none)
    cands = F.when(text.rlike(CANDIDATE), _positions("text_", CANDIDATE, "random")).otherwise(none)
    return F.concat(assign, access, hexes), _tested(cands)


def thresholds(docs: DataFrame, text_col: str = "text", rate: float = 0.01) -> list[tuple[int, int]]:
    """``(band, least decibel)`` accepted by the false-discovery control; at most one row for each band."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    _, cands = _found()
    bins = texts.select(F.explode(cands).alias("x")).groupBy("x.band", "x.decibel").agg(F.count(F.lit(1)).alias("n"))  # 25 bands of 401 bins
    down = Window.partitionBy("band").orderBy(F.desc("decibel")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("band")))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("decibel") / 10) <= rate * F.col("rank") / F.col("m"))
    return [(r["band"], r["d"]) for r in passed.groupBy("band").agg(F.min("decibel").alias("d")).orderBy("band").collect()]


def _in_order(spans: Column) -> Column:
    """By start, then kind."""

    def key(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("nth"), x["end"].alias("end"), x["kind"].alias("kind"), x["body"].alias("body"))

    return F.transform(F.array_sort(F.transform(spans, key)), _plain)


def _plain(x: Column) -> Column:
    return F.struct(*(x[c].alias(c) for c in ("start", "end", "kind", "body")))


def scan(docs: DataFrame, text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """All columns of ``docs`` and ``base_spans``, ``spans``: arrays of (start, end, kind, body), by start, then kind."""
    least = dict(thresholds(docs, text_col, rate))
    base, cands = _found()
    passed = F.filter(cands, lambda x: x["random"])
    texts = docs.withColumn("text_", F.coalesce(F.col(text_col), F.lit(""))).withColumn("base_", base).withColumn("more_", passed)
    by_band = F.array(*(F.lit(least.get(band, 1000)) for band in range(LAST_BAND + 1)))
    more = F.filter("more_", lambda x: (x["decibel"] >= F.element_at(by_band, x["band"] + 1)) & ~F.exists("base_", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return texts.withColumn("base_spans", _in_order(F.col("base_"))).withColumn("spans", _in_order(F.concat("base_", F.transform(more, _plain)))).drop("text_", "base_", "more_")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)``: counts, digest and list of the spans."""
    found = scan(docs.select(F.col(id_col), F.col(text_col)), text_col, rate)

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS[:3])
    return found.select(id_col, *counts, F.sha2(joined("base_spans").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", rate: float = 0.01, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans count as one."""
    found = scan(docs.select(F.struct("*").alias("whole"), F.col(text_col)), text_col, rate)
    cut = F.aggregate(
        F.concat("spans", F.array(F.struct(F.length(text_col).alias("start"), F.length(text_col).alias("end"), F.lit("").alias("kind"), F.lit("").alias("body")))),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.concat(a["out"], F.when(x["start"] >= a["at"], F.substring(F.col(text_col), a["at"] + 1, x["start"] - a["at"])).otherwise(F.lit("")), F.when((x["kind"] != "") & (x["start"] >= a["at"]), F.lit(mark)).otherwise(F.lit(""))).alias("out"),
        ),
        lambda a: a["out"],
    )
    text = F.when(F.size("spans") > 0, cut).otherwise(F.col(text_col)).alias(text_col)
    return found.select(*(text if c == text_col else F.col("whole")[c].alias(c) for c in docs.columns))
