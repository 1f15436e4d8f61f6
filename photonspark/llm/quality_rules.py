"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for every document. ``ledger`` keeps the measurements and one
``fail_bits`` integer with a bit for each failed rule; nothing is decided there. A policy is a
named, versioned set of rules, i.e. a mask: ``apply_policy`` keeps a row when no bit of the mask
is set. Because all policies read the same integer, changing one never reads a text again, and
``ablation`` works on the counts of distinct bit patterns (at most 2**rules rows).

Defined results: a null or empty text has no words and fails ``few_words``; a null ``doc_id``
stays null; rows that repeat are measured each by itself; an empty table gives an empty ledger.
Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonspark.llm.workspace import per_row

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_OTHERS = bytes(c for c in range(256) if c not in SYMBOLS)
_SPACE = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + _CAPITALS.lower()

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    times, covered, upto = Counter(grams), 0, 0
    for at, gram in enumerate(grams):
        if times[gram] > 1:
            covered += at + window - max(at, upto)
            upto = at + window
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if raw.isascii():
        letters = len(raw) - len(raw.translate(None, _LETTERS))
        upper = len(raw) - len(raw.translate(None, _CAPITALS))
    else:
        letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    return (
        len(words),
        len(text or "") - (len(raw) - len(raw.translate(None, _SPACE))),
        len(raw.translate(None, _OTHERS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        letters,
        upper,
    )


def rules() -> dict[str, Column]:
    """Name -> condition that a failing row meets; the position is the bit. Append only."""
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 10 * c("n_symbols") > 2 * c("n_words"),
        "duplicate_lines": 10 * c("n_dup_lines") > 4 * c("n_lines"),
        "shouting": 10 * c("n_upper") > 4 * c("n_letters"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "few_letters": 10 * c("n_letters") < 5 * c("word_chars"),
    }


#: Policy -> version -> rules. A published version never changes.
POLICIES: dict[str, dict[int, tuple[str, ...]]] = {
    "base": {1: ("few_words", "repeated_windows")},
    "training": {1: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "word_length", "few_letters")},
}


def mask(policy: str, version: int) -> int:
    order = list(rules())
    return sum(1 << order.index(name) for name in POLICIES[policy][version])


def _block(columns: dict[str, list]) -> dict[str, list]:
    texts = columns["text"]
    found = list(zip(*map(measure, texts))) if texts else [[] for _ in MEASURES]
    return columns | dict(zip(MEASURES, map(list, found)))


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, measurements and ``fail_bits`` of every row of ``docs``; one pass, no shuffle."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{m} long" for m in MEASURES])
    measured = per_row(docs, list(dict.fromkeys([*keys, "text"])), schema, _block)
    bits = sum((F.when(condition, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, condition in enumerate(rules().values())), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def apply_policy(led: DataFrame, policy: str, version: int, name: str = "kept") -> DataFrame:
    return led.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask(policy, version)).cast("long")) == 0)


def ablation(led: DataFrame, policy: str, version: int) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it removes, and rows kept without it.

    Rows are first counted by bit pattern (partial aggregation, at most 2**rules groups); the
    rest is bitwise work on those counts.
    """
    whole = mask(policy, version)
    order = list(rules())
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).count()
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << order.index(n)).cast("long").alias("bit")) for n in POLICIES[policy][version])))
    each = patterns.select("bits", "count", named.alias("r")).select("bits", "count", "r.rule", "r.bit")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))
    bits, bit = F.col("bits"), F.col("bit")
    return each.groupBy("rule", "bit").agg(
        total(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        total(bits == bit).alias("n_only_this"),
        total(bits.bitwiseAND(F.lit(whole).cast("long").bitwiseXOR(bit)) == 0).alias("n_kept_without"),
        F.bit_or(F.when(bits.bitwiseAND(bit) != 0, bits)).alias("fails_with"),
    )


def quality_ledger(docs: DataFrame, policy: str = "training", version: int = 1, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger with the base verdict and the verdict of one policy version; ``keys`` are carried along."""
    led = apply_policy(ledger(docs, keys), policy, version)
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask("base", 1)).cast("long")) != 0
    return led.withColumn("base_failed", failed).withColumn("kept", F.col("kept") & ~F.col("base_failed")).withColumn("policy", F.lit(f"{policy}@{version}"))
