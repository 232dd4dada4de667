"""Secrets in texts: fixed patterns, and character Markov models of random strings.

Three patterns give the base spans. The method adds to them: tokens without a known form are
cut at their separators, and each piece is scored by two first-order character models, one of random strings and one of ordinary
identifiers. A token counts as secret where a piece has a high log-likelihood ratio per character pair. The
models are trained on labelled samples from all texts: values of base spans are the random strings; long
words of letters, written as names are (camel case, capitals, with digits before or behind), the ordinary identifiers.
Everything is DataFrame expressions; the models end as one array over at most 62 x 62 character pairs, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import stored, whole_row

# The three base patterns and their least lengths.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: In the order of spans that start together.
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that are looked at, what cuts them into pieces, and the least length of a piece that the models score.
CANDIDATE, CUT, PIECE = r"[A-Za-z0-9+/_=-]{8,}", r"[+/_=-]+", 8
#: Words that show ordinary identifiers.
ORDINARY = r"\b[A-Za-z]{10,}\b"
#: Identifiers by their form: UUIDs are random and no secrets.
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Least mean log-likelihood ratio per character pair, in nats.
THRESHOLD = 0.45
#: Shorter pieces need the whole ratio that one of this length has at the threshold.
FULL_LENGTH = 16
#: The characters of pieces; all that the models know.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

SPAN = "struct<kind:int,start:int,end:int>"


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Leftmost non-overlapping matches that ``keep`` accepts, with their places.

    Places follow from the lengths of the text between matches and of the matches, both in code
    points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"))
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")
    )

    def step(acc, x):
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
        out = F.when(keep(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    spans = F.aggregate(both, start, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, in no order.

    The access and hex patterns run to the end of their character class, so asking for the least
    length in the pattern finds what dropping short matches leaves. The value of an assignment is
    tested after matching, because a short value still uses up its text.
    """
    return F.concat(
        _spans(
            text,
            ASSIGN,
            0,
            lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGN_VALUE,
        ),
        _spans(text, ACCESS[:-1] + f"{{{ACCESS_LENGTH - 4},}}", 1, lambda m: F.lit(True)),
        _spans(text, HEX[:-1] + f"{{{HEX_LENGTH},}}", 2, lambda m: F.lit(True)),
    )


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"]),
        ),
        ",",
    )


def pairs(value: Column) -> Column:
    """Neighbouring characters of a string, each pair as one string of two."""
    last = F.length(value) - 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(value, i, F.lit(2)))
    ).otherwise(F.array().cast("array<string>"))


def pair_model(strings: DataFrame) -> DataFrame:
    """One row, ``model``: the log ratio of every character pair, by place in the alphabet.

    ``strings`` (value, random, n) are the labelled samples. The ratio is log P(second | first)
    among random strings minus the same among ordinary ones, with add-one smoothing.
    """
    written = F.when(F.col("random"), F.split("value", CUT)).otherwise(as_names(F.col("value")))
    strings = strings.select("random", "n", F.explode(written).alias("value"))
    each = strings.select("random", "n", F.explode(pairs(F.col("value"))).alias("pair"))
    counts = each.groupBy("pair").agg(
        F.sum(F.when(F.col("random"), F.col("n")).otherwise(0)).alias("r"),
        F.sum(F.when(~F.col("random"), F.col("n")).otherwise(0)).alias("o"),
    )
    letters = F.split(F.lit(ALPHABET), "")
    every = strings.sparkSession.range(1).select(F.explode(letters).alias("a"))
    every = every.filter("a <> ''").select("a", F.explode(letters).alias("b")).filter("b <> ''")
    every = every.withColumn("pair", F.concat("a", "b")).join(
        F.broadcast(counts.filter(F.length("pair") == 2)), "pair", "left"
    )
    total = every.groupBy("a").agg(F.sum("r").alias("tr"), F.sum("o").alias("to"))
    none = F.lit(0)
    chance = lambda n, t: F.ln(
        (F.coalesce(n, none) + 1) / (F.coalesce(t, none) + len(ALPHABET))
    )
    ratio = chance(F.col("r"), F.col("tr")) - chance(F.col("o"), F.col("to"))
    place = F.instr(F.lit(ALPHABET), F.col("a")) * len(ALPHABET) + F.instr(
        F.lit(ALPHABET), F.col("b")
    )
    rows = every.join(F.broadcast(total), "a").select(place.alias("place"), ratio.alias("ratio"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "ratio")))
    return rows.agg(F.transform(ordered, lambda x: x["ratio"]).alias("model"))


def as_names(word: Column) -> Column:
    """A word as it stands in names: by itself, in camel case, in capitals, and with digits at its ends."""
    low = F.lower(word)
    first = F.initcap(low)
    digits = F.lpad(F.pmod(F.xxhash64(low), F.lit(10_000)).cast("string"), 4, "0")
    return F.array(
        word,
        low,
        F.concat(low, first),
        F.concat(first, first),
        F.upper(word),
        F.concat(low, F.substring(digits, 1, 2), low),
        F.concat(first, digits),
        F.concat(digits, first, F.substring(digits, 1, 1), low),
    )


def labelled_strings(rows: DataFrame) -> DataFrame:
    """Random and ordinary strings of texts with base spans (text, base): value, random, n.

    Counted before their characters are looked at: ordinary words repeat.
    """
    value = F.explode(
        F.concat(
            F.transform(
                "base",
                lambda s: F.struct(
                    F.regexp_extract(
                        F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"]),
                        r"([A-Za-z0-9+/_=-]*)[.]*$",
                        1,
                    ).alias("value"),
                    F.lit(True).alias("random"),
                ),
            ),
            F.transform(
                F.regexp_extract_all(F.col("text"), F.lit(ORDINARY), F.lit(0)),
                lambda w: F.struct(w.alias("value"), F.lit(False).alias("random")),
            ),
        )
    )
    each = rows.select(value.alias("s")).select("s.value", "s.random")
    return each.groupBy("value", "random").agg(F.count(F.lit(1)).alias("n"))


def mean_ratio(value: Column, model: Column) -> Column:
    """Mean log-likelihood ratio per character pair of a piece."""

    letters = F.lit(ALPHABET)

    def add(total, pair):
        first, second = F.substring(pair, 1, 1), F.substring(pair, 2, 1)
        place = (F.instr(letters, first) - 1) * len(ALPHABET) + F.instr(letters, second)
        return total + F.element_at(model, place)

    return F.aggregate(pairs(value), F.lit(0.0), add) / (F.length(value) - 1)


def markov_spans(text: Column, model: Column, base: Column, threshold: float) -> Column:
    """Candidates outside the base spans with a piece whose mean ratio reaches the threshold.

    Pieces need a letter. Below ``FULL_LENGTH`` the threshold grows with the pairs that are missing, so that short ordinary words
    with a few odd pairs stay.
    """

    def odd(piece):
        least = F.greatest(F.lit(1.0), (FULL_LENGTH - 1) / (F.length(piece) - 1))
        some = (F.length(piece) >= PIECE) & piece.rlike("[A-Za-z]")
        return some & (mean_ratio(piece, model) >= threshold * least)

    def random(m):
        return F.exists(F.split(m, CUT), odd) & ~m.rlike(UUID)

    spans = _spans(text, CANDIDATE, 3, random)

    def fits(s):
        return ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return F.filter(spans, fits)


def train(texts: DataFrame) -> DataFrame:
    """The pair model of all rows of ``texts`` (text)."""
    rows = texts.select("text", base_spans(F.col("text")).alias("base"))
    return pair_model(labelled_strings(rows))


def _with_spans(rows: DataFrame, text: str, threshold: float) -> DataFrame:
    """Adds ``_spans`` (kind, start, end; by start) to rows; needs no shuffle and no key."""
    model = stored(train(rows.select(F.col(text).alias("text"))), "secret-model").scalar()
    names = rows.columns
    rows = rows.withColumn("_base", base_spans(F.col(text))).withColumn("_model", model)
    more = markov_spans(F.col(text), F.col("_model"), F.col("_base"), threshold)
    both = F.transform(
        F.concat("_base", more), lambda s: F.struct(s["start"], s["kind"], s["end"])
    )
    return rows.select(*names, F.array_sort(both).alias("_spans"))


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Secrets of every text: doc_id, text, spans (kind, start, end) with places in code points.

    ``spans`` holds the base spans and those that the models add, by start. A null text counts as
    empty and has none; every input row gives one output row; an empty table gives none. Without
    a single labelled string all ratios are 0 and the models add nothing. Other input columns
    are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return _with_spans(rows, "text", threshold).withColumnRenamed("_spans", "spans")


def span_counts(found: DataFrame) -> DataFrame:
    """Digest columns of ``find_secrets`` rows."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; overlapping spans become one mark."""
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.element_at(name, s["kind"] + 1)).otherwise("")
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], gap, mark).alias("out"),
        )

    def rest(acc):
        return F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def mask_secrets(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD):
    """The input's rows with every secret in the text replaced by its kind in brackets.

    Null and empty texts and all other columns stay as they are, whatever their names; every input row gives one row, repeated ones
    and those with null ids too; an empty table gives none.
    """
    # The input's columns in one, so that no name can clash.
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = _with_spans(docs.select(whole_row(docs), whole.alias("whole")), "whole", threshold)
    clean = masked(F.col("whole"), F.col("_spans"))
    text = F.when(F.size("_spans") > 0, clean).otherwise(F.col("row")[text_col])
    return rows.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")
