"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit per failed rule; a policy is a named, versioned mask over those
bits, so verdicts, policy changes and ablations never look at a text again.

Everything is a row-local column expression: no shuffle, no Python. Counting
repeated windows hashes each window once; only documents in which two windows
agree pay for the sort that finds the covered words.

Defined results: a null text counts as empty (no words, so ``few_words``
fails); repeated rows give repeated rows; an empty table gives an empty
ledger; columns of the input other than the key and the text are not carried
unless named in ``keep``, which names that the ledger gives itself are not let into.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.session import staged

# White space between words, symbols counted, window length in words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: Callable[[], Column]
    sql: str


def _rule(name: str, sql: str) -> Rule:
    return Rule(name, lambda: F.expr(sql), sql)


# Integer arithmetic only, so that every engine decides alike.
RULES = [
    _rule("few_words", "n_words < 20"),
    _rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    _rule("symbols", "10 * n_symbols > n_words"),
    _rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    _rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    _rule("capitals", "2 * n_capitals > word_chars"),
    _rule("digits", "2 * n_digits > word_chars"),
    _rule("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    _rule("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
]
BASE = ("few_words", "repeated_windows")
MEASUREMENTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_digits", "n_capitals", "n_bullet_lines", "n_ellipsis_lines",
)
# Policy versions: names of the rules that reject.
POLICIES = {
    "base": BASE,
    "prose-v1": BASE + ("symbols", "capitals", "digits"),
    "prose-v2": tuple(r.name for r in RULES),
}
CURRENT = "prose-v2"


def mask(names: tuple[str, ...] | list[str]) -> int:
    """The bits of the named rules."""
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[n] for n in set(names))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _covered(starts: Column) -> Column:
    """Words covered by windows that begin at the given ascending positions."""
    overlaps = F.transform(
        F.when(F.size(starts) > 1, F.sequence(F.lit(1), F.size(starts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.greatest(F.lit(0), F.lit(WINDOW) - (starts[k] - starts[k - 1])),
    )
    return F.lit(WINDOW) * F.size(starts) - F.aggregate(overlaps, F.lit(0), lambda a, x: a + x)


def _repeated(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | (
            (k < last) & (s[F.least(k + 1, last)]["h"] == s[k]["h"])
        )
        return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda k: s[k]["i"]))

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _let(F.array_sort(pairs), lambda s: _let(starts(s), _covered))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., measurements..., rule_bits): one row per input row."""
    kept = [c for c in keep or [] if c not in (key, *MEASUREMENTS, "rule_bits")]
    base = docs.select(key, *kept, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = base.select(
        key, *kept,
        # Symbols, digits and capitals in one pass over the text; they are told apart in what is left of it.
        F.regexp_replace("_text", f"[^{SYMBOLS}0-9" + r"\p{Lu}]+", "").alias("_marks"),
        F.array_remove(F.split("_text", SPACE), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("_lines"),
    )
    n = F.size("_words")
    hashed = split.withColumn(
        "_windows",
        F.when(
            n >= WINDOW,
            _let(
                F.transform("_words", lambda w: F.xxhash64(w)),
                lambda h: F.transform(
                    F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + j] for j in range(WINDOW)])
                ),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    unique = F.size(F.array_distinct("_windows"))
    count = lambda pattern: F.length(F.regexp_replace("_marks", pattern, "")).cast("long")
    bullet = lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "\u2022")
    trailing = lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("\u2026"))
    measured = hashed.select(
        key, *kept,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        count(f"[^{SYMBOLS}]+").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(unique < F.size("_windows"), _repeated(F.col("_windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        count("[^0-9]+").alias("n_digits"),
        count(r"\P{Lu}+").alias("n_capitals"),
        F.size(F.filter("_lines", bullet)).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", trailing)).cast("long").alias("n_ellipsis_lines"),
    )
    bits = sum((F.when(r.fails(), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)), F.lit(0))
    return measured.withColumn("rule_bits", bits.cast("long"))


def verdict(rule_bits: Column | str, policy: str = CURRENT) -> Column:
    """True where no rule of the policy failed."""
    bits = F.col(rule_bits) if isinstance(rule_bits, str) else rule_bits
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with ``base_failed``, ``kept`` and the policy's name."""
    base = rows["rule_bits"].bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return rows.withColumns({"base_failed": base, "kept": ~base & verdict("rule_bits", policy), "policy": F.lit(policy)})


def ablations(rows: DataFrame) -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_kept, n_only): what each rule of each policy decides.

    The ledger is reduced to counts per bit pattern first (at most one row per
    pattern, 2^rules), and every policy and rule is answered from those.
    ``n_only`` documents are rejected by that rule alone.
    """
    patterns = rows.groupBy("rule_bits").agg(F.count("*").alias("n"))
    cases = [
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(names)).cast("long").alias("all"), F.lit(mask([r])).cast("long").alias("one"))
        for p, names in POLICIES.items() for r in names
    ]
    cut = patterns.select("rule_bits", "n", F.inline(F.array(*cases)))
    hit = F.col("rule_bits").bitwiseAND(F.col("all"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return cut.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(F.col("rule_bits").bitwiseAND(F.col("one")) != 0).alias("n_failed"),
        total(hit == 0).alias("n_kept"),
        total(hit == F.col("one")).alias("n_only"),
    )


def stored_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The ledger of whole rows (``_row``), written below the shared folder as ``quality-ledger-*`` and read again.

    Later policies and ablations are asked of the written table; only the columns they name are read.
    """
    return staged(ledger(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_body")), "_row", "_body"), "quality-ledger")


def quality_stage(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The input rows, columns unchanged, that the policy keeps; bits and measurements of all stay in the stored ledger."""
    return apply_policy(stored_ledger(docs, text), policy).where("kept").select("_row.*")
