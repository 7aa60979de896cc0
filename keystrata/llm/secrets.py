"""Secret scans, with DataFrame functions only: patterns and a randomness test battery.

Base spans: `assign`, `access` and `hex` matches, leftmost and non-overlapping per kind.
Spans come from splitting a text at a pattern: gaps and matches alternate, so running
lengths give code-point positions.

Battery: each long token of letters, digits and +/_=- that has a digit and a letter and is
not within one base span gets an inferred encoding (hex, base32, lower or upper base36,
base62, base64, or all of these symbols).  Three tests ask
whether it may be uniform random: chi-squared of its symbols over the alphabet, runs about
the alphabet's middle, and serial correlation of its symbol values.  Their p-values are
combined (Bonferroni), and a Benjamini-Hochberg procedure per length class, over the
tokens of all documents, rejects the ones that are not random.  The tokens that survive and
carry at least `MIN_BITS` are spans of kind `random`.  What is controlled is the share of
truly random tokens among the rejected ones (secrets lost, at most `FDR`), not the share of
plain tokens among the spans.  P-values count in bins of a factor 2**(1/OCTAVE) down to
2**-SMALLEST (rounded up: against rejection), so the procedure sees a table of fixed size at
any number of tokens.

Edge cases: a null or empty text has no spans and the hash of the empty string; an empty
table gives no rows; repeated rows are scanned one by one; tokens may have any length; ties
in start go by the kinds' order; a random span may overlap base spans, but for those that
hold it; a token without a digit or without a letter is not tested; rows without an id are
scanned like others; further columns are ignored by `scan` but those in `keep` (none may be
named base, tokens, cand, cuts or found), and kept whatever their names by `redact`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
FDR, MIN_BITS = 0.05, 90.0
#: Bins of p-values: OCTAVE to a factor of two, those below 2**-SMALLEST in one.
OCTAVE, SMALLEST = 8, 100
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets of the encodings, in the order of their symbols' values.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGIT + "abcdef"), ("hexu", "^[0-9A-F]+$", DIGIT + "ABCDEF"), ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", DIGIT + LOWER), ("base36u", "^[A-Z0-9]+$", DIGIT + UPPER), ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGIT),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGIT + "+/"), ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGIT + "-_"),
    ("base66", "^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGIT + "+/-_"),
)


def spans(text, pattern: str, kind: int):
    """array<struct(start, kind, end, s)> of a pattern's matches; kind is its place in KINDS."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")), lambda x: F.struct(F.char_length(x["g"]).cast("long").alias("g"), x["m"].alias("m")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,kind:int,end:long,s:string>>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["g"]
        end = begin + F.char_length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("s")))).alias("out"))

    empty = start["out"]
    return F.when(F.size(found) > 0, F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(empty)


def _upper_tail(z):
    """1 - Phi(z) (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def tested(tokens):
    """array of struct(start, kind, end, r = struct(encoding, n, p, bits)) of the tokens that
    have an encoding; p is the combined p-value of randomness.  Each step's values are
    fields of the next one's elements, so that no expression is repeated."""

    def more(array, **fields):
        def put(x):
            return F.struct(*(x[c].alias(c) for c in keep), *(f(x).alias(n) for n, f in fields.items()))

        out = F.transform(array, put)
        keep.extend(fields)
        return out

    def encoding(x):
        which = F.when(~(x["s"].rlike("[0-9]") & x["s"].rlike("[A-Za-z]")), F.lit(None).cast("int"))
        for i, (_, pattern, _) in enumerate(ENCODINGS):
            which = which.when(x["body"].rlike(pattern), F.lit(i))
        return which

    def squares(x):
        counts = F.transform(F.split(x["alphabet"], ""), lambda c: x["n"] - F.char_length(F.replace(x["body"], c, F.lit(""))))
        return F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)

    def halves(x):
        half = (x["k"] / 2).cast("int")
        low = F.call_function("translate", x["body"], F.substring(x["alphabet"], F.lit(1), half), F.repeat(F.lit("~"), half))
        return F.regexp_replace(F.regexp_replace(low, "[^~]", "1"), "~", "0")

    def without(x, part):
        return (x["n"] - F.char_length(F.replace(x["bits"], F.lit(part), F.lit("")))) / len(part)

    def products(x):
        near = F.zip_with(F.slice(x["values"], 1, F.size(x["values"]) - 1), F.slice(x["values"], 2, F.size(x["values"]) - 1), lambda a, b: a * b)
        return F.aggregate(near, F.lit(0.0), lambda a, v: a + v)

    keep = ["start", "kind", "end", "s"]
    x = more(tokens, body=lambda x: F.regexp_replace(x["s"], "=+$", ""))
    x = F.filter(more(x, which=encoding), lambda x: x["which"].isNotNull())
    x = more(x, alphabet=lambda x: F.element_at(F.array(*(F.lit(a) for *_, a in ENCODINGS)), x["which"] + 1), n=lambda x: F.char_length(x["body"]).cast("double"))
    x = more(x, k=lambda x: F.char_length(x["alphabet"]).cast("double"), squares=squares)
    x = more(x, bits=halves, df=lambda x: x["k"] - 1, chi=lambda x: x["k"] / x["n"] * x["squares"] - x["n"], values=lambda x: F.transform(F.split(x["body"], ""), lambda c: F.instr(x["alphabet"], c) - (x["k"] + 1) / 2))
    x = more(x, ones=lambda x: without(x, "1"), runs=lambda x: without(x, "01") + without(x, "10") + 1, products=products, power=lambda x: F.greatest(F.aggregate(x["values"], F.lit(0.0), lambda a, v: a + v * v), F.lit(1e-9)))
    keep.remove("values")
    x = more(x, mean=lambda x: 2 * x["ones"] * (x["n"] - x["ones"]) / x["n"] + 1)
    x = more(x, z_chi=lambda x: (F.cbrt(x["chi"] / x["df"]) - (1 - 2 / (9 * x["df"]))) / F.sqrt(2 / (9 * x["df"])), z_runs=lambda x: F.abs(x["runs"] - x["mean"]) / F.sqrt(F.greatest((x["mean"] - 1) * (x["mean"] - 2) / (x["n"] - 1), F.lit(1e-9))), z_serial=lambda x: F.abs(x["products"] / x["power"]) * F.sqrt(x["n"]))
    one_side = lambda x: (x["ones"] == 0) | (x["ones"] == x["n"])
    x = more(x, p_chi=lambda x: _upper_tail(x["z_chi"]), p_runs=lambda x: F.when(one_side(x), F.pow(F.lit(0.5), x["n"] - 1)).otherwise(2 * _upper_tail(x["z_runs"])), p_serial=lambda x: 2 * _upper_tail(x["z_serial"]))
    names = F.array(*(F.lit(e[0]) for e in ENCODINGS))
    return F.transform(x, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.struct(F.element_at(names, x["which"] + 1).alias("encoding"), x["n"].cast("long").alias("n"), F.least(F.lit(1.0), 3 * F.least(x["p_chi"], x["p_runs"], x["p_serial"])).alias("p"), (x["n"] * F.log2(x["k"])).alias("bits")).alias("r")))


def p_bin(p):
    """Number of the bin of a p-value: 0 for 1, the larger the smaller p; bin b holds p up to
    2**(-b/OCTAVE)."""
    return F.floor(F.least(F.lit(float(SMALLEST)), -F.log2(F.greatest(p, F.lit(2.0**-SMALLEST)))) * OCTAVE + 1e-9).cast("int")


def cutoffs(bins: DataFrame) -> DataFrame:
    """c, cut of bins(c, bin, k): the least bin that Benjamini-Hochberg rejects in each class;
    all bins from there on are rejected, none if cut is beyond them."""
    own = F.array_sort(F.collect_list(F.struct((-F.col("bin")).alias("small"), "k")))  # small p first
    by = bins.groupBy("c").agg(own.alias("b"), F.sum("k").alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("rank"), F.lit(SMALLEST * OCTAVE + 1).alias("cut"))

    def step(a, x):
        rank = a["rank"] + x["k"]
        return F.struct(rank.alias("rank"), F.when(F.pow(F.lit(2.0), x["small"] / OCTAVE) <= FDR * rank / F.col("m"), -x["small"]).otherwise(a["cut"]).alias("cut"))

    return by.select("c", F.aggregate("b", start, step, lambda a: a["cut"]).alias("cut"))


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and found: arrays of struct(start, kind, end), plus the columns named in `keep`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(spans(text, ASSIGN, 0), lambda x: F.char_length(F.regexp_extract(x["s"], ASSIGN, 2)) >= 6)
    base = F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2))
    src = docs.select("doc_id", *keep, base.alias("base"), spans(text, TOKEN, 3).alias("tokens"))
    # a token is tested whole unless one base span covers it
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    plain = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    cand = tested(free)
    rows = saved(src.select("doc_id", *keep, F.array_sort(plain("base")).alias("base"), cand.alias("cand")))

    def length_class(n):
        return F.floor(F.log2(n.cast("double"))).cast("int")

    bins = rows.select(F.explode("cand.r").alias("r")).select(length_class(F.col("r.n")).alias("c"), p_bin(F.col("r.p")).alias("bin")).groupBy("c", "bin").agg(F.count("*").alias("k"))
    cuts = cutoffs(bins).agg(F.map_from_entries(F.collect_list(F.struct("c", "cut"))).alias("cuts")).scalar()
    good = F.filter("cand", lambda x: (x["r"]["bits"] >= MIN_BITS) & (p_bin(x["r"]["p"]) < F.try_element_at("cuts", length_class(x["r"]["n"]))))
    return rows.withColumn("cuts", cuts).select("doc_id", *keep, "base", F.array_sort(F.concat("base", plain(good))).alias("found"))


def line(column: str):
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    def number(i):
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("found").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by its kind in brackets; all columns stay,
    n_chars follows the text."""
    # the whole row travels in one column, so that no name of it can clash
    rows = docs.select(F.lit(0).alias("doc_id"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = scan(rows, ("text", "row"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    kinds = F.array(*(F.lit(k) for k in KINDS))

    def step(a, x):
        head = F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(x["start"] - a["at"], F.lit(0)).cast("int"))
        more = F.when(x["start"] >= a["at"], F.concat(a["out"], F.array(head, F.concat(F.lit("["), F.element_at(kinds, x["kind"] + 1), F.lit("]"))))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), more.alias("out"))

    whole = F.aggregate("found", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    hit, kinds_of = F.size("found") > 0, {f.name: f.dataType for f in docs.schema}
    both = F.transform(F.array(whole), lambda t: F.struct(t.alias("text"), F.char_length(t).alias("n")))[0]
    found = found.withColumn("new", F.when(hit, both))
    new = {"text": F.when(hit, F.col("new.text")).otherwise(F.col("text")), "n_chars": F.when(hit, F.col("new.n")).otherwise(F.col("row")["n_chars"]) if "n_chars" in kinds_of else None}
    return found.select(*((new[c] if c in new else F.col("row")[c]).cast(kinds_of[c]).alias(c) for c in docs.columns))
