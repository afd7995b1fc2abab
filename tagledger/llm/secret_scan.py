"""Secret scan with a randomness test battery, in DataFrame functions only.

Three patterns give the base spans. Beside them, every long run of key characters
is tested for being drawn evenly from its inferred alphabet: chi-squared of the
symbols and of digits against letters, runs above and below the alphabet's middle, and
serial correlation, each as a normal deviate; their squares add up to a distance from
randomness. Runs of letters alone are the background of ordinary words, per band
of length; a run with letters and digits gets the share of its background that looks as
random as its p-value, and Benjamini-Hochberg over all of these keeps the false
discoveries below FALSE_RATE. One pass over the texts; what it stores is small,
and the histograms that set the limits have at most BANDS x BINS cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagledger.llm.shared import store

# The kinds with their patterns, and the least length of a group of them. Access and hex ask for
# their length at once: a shorter match cannot hide a long one, as it ends where its run of characters ends.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}
NEEDED = {"assign": (":", "="), "access": ("AKIA",)}
RUN = "[A-Za-z0-9+/_-]{20,}"
#: Whole runs with a digit and a letter.
MIXED = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])" + RUN
# Alphabets of keys, all with digits: a pattern, the number of symbols, how many are digits, the last code of the
# lower half. The first that fits is the inferred encoding; ordinary words are held against it just the same.
ALPHABETS = (
    ("[0-9]+", 10, 10, "4"), ("[0-9a-f]+|[0-9A-F]+", 16, 10, "7"), ("[A-Z2-7]+", 32, 6, "J"),
    ("[a-z0-9]+", 36, 10, "h"), ("[A-Z0-9]+", 36, 10, "H"), ("[A-Za-z0-9]+", 62, 10, "U"), (".*", 64, 10, "U"),
)
BANDS, BAND = 16, 8
BINS, STEP = 64, 0.5
FALSE_RATE = 0.05


def _spans(text: Column, pattern: str, matches: Column) -> Column:
    """(start, end) of each match in code points, from the pieces between the matches."""
    before = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(matches, F.char_length)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["b"]
        stop = start + F.coalesce(pair["s"], F.lit(0))
        return F.struct(stop.alias("at"), F.when(pair["s"].isNull(), acc["found"]).otherwise(F.concat(
            acc["found"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).alias("found"))

    pairs = F.arrays_zip(before.alias("b"), sizes.alias("s"))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, empty, step)["found"]).otherwise(empty["found"])


def _alphabet(run: Column, value) -> Column:
    """``value`` of the first alphabet that the run fits."""
    out = F.lit(None).cast("int")
    for alphabet in reversed(ALPHABETS):
        out = F.when(run.rlike(f"^(?:{alphabet[0]})$"), value(alphabet)).otherwise(out)
    return out


def _deviates(x: Column) -> Column:
    """The squared deviates of the tests, added up, for a struct of what they need."""
    codes, symbols, mean = x["codes"], x["symbols"], x["mean"]
    n = F.size(codes).cast("double")
    zero = F.struct(F.lit(-1).alias("prev"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))  # doubles, as squares of long runs overflow

    def count(acc: Column, code: Column) -> Column:
        run = F.when(code == acc["prev"], acc["run"] + 1.0).otherwise(1.0)
        return F.struct(code.alias("prev"), run.alias("run"), (acc["sum"] + 2 * run - 1).alias("sum"))

    squares = F.aggregate(F.array_sort(codes), zero, count)["sum"]  # of the symbols' counts
    chi = (symbols * squares / n - n - (symbols - 1)) / F.sqrt(2.0 * (symbols - 1) * (n - 1) / n)
    turns = F.size(F.filter(codes, lambda c, i: (c > x["middle"]) != (F.get(codes, i - 1) > x["middle"])))
    runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    spread = F.aggregate(codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
    lagged = F.aggregate(F.transform(codes, lambda c, i: F.coalesce(
        (c - mean) * (F.get(codes, i - 1) - mean), F.lit(0.0))), F.lit(0.0), lambda a, c: a + c)
    serial = F.when(spread > 0, lagged / spread * F.sqrt(n)).otherwise(F.sqrt(n))
    share = x["digits"] / symbols
    found = F.size(F.filter(codes, lambda c: (c >= ord("0")) & (c <= ord("9"))))
    digits = F.when(share < 1, F.pow(found - n * share, 2) / (n * share * (1 - share))).otherwise(0.0)
    return F.pow(F.greatest(chi, F.lit(0.0)), 2) + digits + F.pow(runs, 2) + F.pow(serial, 2)


def _cell(x: Column) -> Column:
    """Band of length and bin of the distance as one number."""
    band = F.least(F.floor(F.size(x["codes"]) / BAND), F.lit(BANDS - 1)).cast("int")
    bin_ = F.least(F.floor(_deviates(x) / STEP), F.lit(BINS - 1)).cast("int")
    return band * BINS + bin_


def _matches(kind: str, group: int) -> Column:
    """All matches of a pattern. Texts without a character or string that it cannot do without are not searched."""
    found = F.regexp_extract_all("text", F.lit(PATTERNS[kind][0]), F.lit(group))
    needed = NEEDED.get(kind)
    if not needed:
        return found
    there = F.contains(F.col("text"), F.lit(needed[0]))
    for other in needed[1:]:
        there = there | F.contains(F.col("text"), F.lit(other))
    return F.when(there, found).otherwise(F.array().cast("array<string>"))


def _scan(docs: DataFrame) -> DataFrame:
    """Per row: base spans as (start, kind, stop), the background's cells, and candidates
    as (start, stop, cell)."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "*", F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("words"),
        F.regexp_extract_all("text", F.lit(MIXED), F.lit(0)).alias("mixed"),
        *[_matches(k, 0).alias(f"all_{k}") for k in PATTERNS],
        *[_matches(k, g).alias(f"group_{k}") for k, (_, g, _) in PATTERNS.items()])

    def good(kind: str) -> Column:
        pattern, _, least = PATTERNS[kind]
        pairs = F.arrays_zip(_spans(F.col("text"), pattern, F.col(f"all_{kind}")).alias("at"),
                             F.col(f"group_{kind}").alias("g"))
        return F.transform(F.filter(pairs, lambda x: F.char_length(x["g"]) >= least), lambda x: F.struct(
            x["at"]["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["at"]["stop"].alias("stop")))

    plain = F.filter("words", lambda r: ~r.rlike("[0-9]"))
    places = _spans(F.col("text"), MIXED, F.col("mixed"))  # only the few mixed runs need places
    return found.select(
        "doc_id", F.array_sort(F.concat(*[good(k) for k in PATTERNS])).alias("base"),
        F.transform(plain, lambda r: _described(r)).alias("plain"),
        F.transform("mixed", lambda r: _described(r)).alias("mixed"), places.alias("places"),
    ).select(
        "doc_id", "base", F.transform("plain", lambda x: _cell(x)).alias("background"),
        F.transform(F.arrays_zip("places", "mixed"), lambda x: F.struct(
            x["places"]["start"].alias("start"), x["places"]["stop"].alias("stop"),
            _cell(x["mixed"]).alias("cell"))).alias("candidates"))


def _described(run: Column) -> Column:
    """A run as a struct of what its tests need."""
    codes = F.transform(F.split(run, ""), F.ascii)
    return F.transform(F.array(codes), lambda c: F.struct(
        c.alias("codes"), _alphabet(run, lambda a: a[1]).alias("symbols"), _alphabet(run, lambda a: a[2]).alias("digits"),
        _alphabet(run, lambda a: ord(a[3])).alias("middle"),
        (F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).alias("mean")))[0]


def _limits(scanned: DataFrame) -> dict[int, int]:
    """The largest accepted bin of each band. What comes to the driver is a histogram of fixed size."""
    cells = scanned.select(F.lit(True).alias("word"), F.explode("background").alias("cell")).unionByName(
        scanned.select(F.lit(False).alias("word"), F.explode("candidates.cell").alias("cell"))).groupBy(
        "word", "cell").count().collect()
    words, candidates = {}, {}
    for row in cells:
        (words if row["word"] else candidates)[row["cell"]] = row["count"]
    tests = []  # (p, band, bin, candidates), p from words of this band of length and shorter ones
    for cell, n in candidates.items():
        band, bin_ = divmod(cell, BINS)
        pool = [(c % BINS, m) for c, m in words.items() if c // BINS <= band]
        tests.append(((1 + sum(m for b, m in pool if b <= bin_)) / (1 + sum(m for _, m in pool)), band, bin_, n))
    tests.sort()
    total, so_far, limit = sum(candidates.values()), 0, -1.0
    for p, _, _, n in tests:
        so_far += n
        if p * total <= FALSE_RATE * so_far:
            limit = p
    accepted: dict[int, int] = {}
    for p, band, bin_, _ in tests:
        if p <= limit:
            accepted[band] = max(bin_, accepted.get(band, -1))
    return accepted


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) per row of documents: arrays of (start, kind, stop), by start and then
    kind; kind counts in KINDS, places are code points, stop exclusive. Spans of the tests that lie in a base
    span are left out. Empty texts have none."""
    scanned = store(_scan(docs), "secrets")
    accepted = _limits(scanned)

    def passes(x: Column) -> Column:
        ok = F.lit(False)
        for band, bin_ in accepted.items():
            ok = ok | ((F.floor(x["cell"] / BINS) == band) & (x["cell"] % BINS <= bin_))
        return ok & ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["stop"] <= b["stop"]))

    more = F.transform(F.filter("candidates", passes), lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["stop"].alias("stop")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def printed(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
