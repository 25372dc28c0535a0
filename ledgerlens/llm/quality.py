"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once a document; the ledger keeps its measurements and the set of failed rules as bits. A policy
is a named mask over those bits, so changing a policy or asking what one rule costs never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WORD, WS_CHARS, set_aside

SYMBOLS = "#*$%&|<>"  # fixed value


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements, true for a document that breaks the rule."""

    name: str
    fails: str


#: Bit k of `fail_bits` belongs to RULES[k]; rules are only ever appended, so that old ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 15 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines_with_word"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 15 * n_words"),
    Rule("shouting", "100 * n_upper > 40 * word_chars"),
    Rule("exclamation", "100 * n_exclaim > 30 * n_words"),
)


def mask(*names: str) -> int:
    bits = {r.name: 1 << k for k, r in enumerate(RULES)}
    return sum(bits[n] for n in names)


BASE = mask("too_few_words", "repeated_windows")

#: Versioned policies: (version, mask of the rules that reject).
POLICIES = {
    "base": BASE,
    "v1": BASE | mask("symbols", "repeated_lines"),
    "v2": BASE | mask("symbols", "repeated_lines", "word_length", "shouting", "exclamation"),
}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from `__words`: words inside 3-word windows that occur twice or more.

    Each window gets a long: its hash above, its place below; sorting longs brings equal windows together. Neighbours
    with equal hashes are compared word by word, so a hash collision can't report a repeat. The places of repeated
    windows are sorted again and each adds the words by which it reaches further than the one before.
    """
    last = F.size("__words") - 3
    place = F.ceil(F.log2(F.size("__words") + F.lit(1))).cast("int")
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.call_function("shiftleft", F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)), F.col("__place")).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("__place", place)
    df = df.withColumn("__windows", F.when(F.size("__words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__sorted", F.sort_array("__windows"))
    at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__place")) - 1).cast("int")
    key = lambda x: F.call_function("shiftright", x, F.col("__place"))

    def same(x: Column, y: Column) -> Column:
        i, j = at(x), at(y)
        words = [F.get("__words", i + k) == F.get("__words", j + k) for k in range(3)]
        return F.coalesce((key(x) == key(y)) & words[0] & words[1] & words[2], F.lit(False))

    hit = F.filter("__sorted", lambda x, i: same(x, F.get("__sorted", i - 1)) | same(x, F.get("__sorted", i + 1)))
    df = df.withColumn("__hit", F.transform(hit, at)).withColumn("__hit", F.sort_array("__hit"))
    covered = F.aggregate(
        "__hit",
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct((i + 2).alias("end"), (acc["n"] + F.least(F.lit(3), i + 2 - acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", covered)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of the rules; null text counts as empty. Texts are read whole; no shuffle.

    Only a row's own arrays are held, so memory follows the longest text. A column of docs with the name of a measurement is
    replaced by it; all others stay. Equal rows are measured each by itself.
    """
    columns = docs.columns
    docs, back = set_aside(docs, "doc_id", text)
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) > 0)
    df = docs.withColumn("__t", t)
    df = df.withColumns({"__words": F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)), "__lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(_without(F.col("__t"), WS_CHARS)).cast("long"),
            "n_symbols": (F.length("__t") - F.length(_without(F.col("__t"), SYMBOLS))).cast("long"),
            "n_upper": (F.length("__t") - F.length(F.regexp_replace("__t", r"\p{Lu}", ""))).cast("long"),
            "n_exclaim": (F.length("__t") - F.length(_without(F.col("__t"), "!"))).cast("long"),
            "n_lines_with_word": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    )
    # A generator is a barrier: a filter on a measurement would otherwise be pushed below these projections, which puts
    # the words' expression into the functions that run for each word.
    names = ("n_words", "word_chars", "n_symbols", "n_upper", "n_exclaim", "n_lines_with_word", "n_dup_lines", "n_repeat_words")
    rest = docs.columns
    found = _repeat_words(df).select(*rest, F.explode(F.array(F.struct(*names))).alias("__m"))
    kept = [c for c in columns if c not in names]
    return back(found, F.col("__m")).select(*("`" + c.replace("`", "``") + "`" for c in kept), "__m.*")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with measurements and `fail_bits`: every rule evaluated once."""
    bits = F.lit(0)
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)))
    return measure(docs, text).withColumn("fail_bits", bits)


def stored(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """The ledger as a table without texts, written to path (a new folder) or a scratch table, and read from there.

    Policies and ablations of the result, in this session or a later one, read measurements and bits only.
    """
    led = ledger(docs, text).drop(text)
    if path is None:
        return Scratch(docs.sparkSession).write(led, "ledger")
    led.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def verdict(policy: str, bits: str = "fail_bits") -> Column:
    """True where the document passes every rule of the policy."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents it fails, those only it rejects, and those kept without it.

    The ledger shrinks to one count for each pattern of bits (at most 2^rules rows, map-side first) before the rules
    are crossed with it.
    """
    full = POLICIES[policy]
    patterns = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).alias("bit")) for k, r in enumerate(RULES) if full >> k & 1)))
    hit = F.col("fail_bits").bitwiseAND(F.lit(full))
    rows = patterns.withColumn("r", rules).select("n", hit.alias("__hit"), "r.rule", "r.bit")
    rest = F.col("__hit").bitwiseAND(F.lit(full) - F.col("bit"))
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("__hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("__hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_by_this"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def quality_digest(docs: DataFrame, policy: str = "v2") -> DataFrame:
    led = stored(docs.select("doc_id", "text"))
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE)) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict(policy).alias("kept"), "fail_bits")
