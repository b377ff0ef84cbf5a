"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document.  The ledger holds its measurements and
one failure bit a rule; a policy is a named, versioned mask over these bits, so
that changing a policy, or asking what a rule costs, never reads a text again.

Defined results: a null text is an empty one; an empty text has zero
measurements and fails ``few_words``; repeated rows give repeated results; an
empty table gives an empty ledger.  Only the id and the text are read, other
columns are left out of the ledger, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, let

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A bit number, a name and the condition of failure over measurements."""

    bit: int
    name: str
    fails: Callable[[dict[str, Column]], Column]


#: Bits are never reused: a ledger written by one version is read by the next.
RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 20),
    Rule(1, "repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30),
    Rule(2, "symbols", lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule(3, "duplicate_lines", lambda m: (m["n_lines"] >= 4) & (m["n_dup_lines"] * 10 > m["n_lines"] * 3)),
    Rule(4, "long_words", lambda m: m["word_chars"] > m["n_words"] * 40),
    Rule(5, "short_words", lambda m: m["word_chars"] < m["n_words"] * 2),
    Rule(6, "capitals", lambda m: m["n_upper"] * 2 > m["word_chars"]),
    Rule(7, "few_letters", lambda m: m["n_letters"] * 2 < m["word_chars"]),
)
MEASURED = ("n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", "n_upper", "n_letters")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(r.name for r in RULES))


def _repeat_words(words: Column, window: int) -> Column:
    """How many words lie in a ``window``-word run that occurs twice or more."""

    def covered(at: Column) -> Column:
        ends = F.transform(
            at,
            lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(window), F.get(at, i + 1) - p)).otherwise(window),
        )
        return F.aggregate(ends, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda s: let(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True)
                            | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True),
                        ),
                        lambda x: x["i"],
                    )
                ),
                covered,
            ),
        )

    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window))
    )
    return F.when(
        F.size(words) > window,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))),
    ).otherwise(0)


def measurements(text: Column) -> Column:
    """A struct of everything the rules read, and ``failed``: one expression, so
    that a filter on it computes it once."""
    has_word = r"[^\x20\x09-\x0D]"

    def of_text(t: Column) -> Column:
        w = let(
            blank_words(t),
            lambda w: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                _repeat_words(w, WINDOW).cast("bigint").alias("n_repeat_words"),
            ),
        )
        lines = let(
            F.filter(F.split(t, "\n"), lambda x: x.rlike(has_word)),
            lambda x: F.struct(
                F.size(x).cast("bigint").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            ),
        )
        return F.struct(
            w.alias("w"),
            lines.alias("l"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            F.char_length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
            F.char_length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("bigint").alias("n_letters"),
        )

    def flat(x: Column) -> Column:
        fields = {c: x["w"][c] for c in ("n_words", "word_chars", "n_repeat_words")}
        fields |= {c: x["l"][c] for c in ("n_lines", "n_dup_lines")}
        fields |= {c: x[c] for c in ("n_symbols", "n_upper", "n_letters")}
        failed = F.lit(0).cast("bigint")
        for r in RULES:
            failed = failed.bitwiseOR(F.when(r.fails(fields), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
        return F.struct(*(v.alias(c) for c, v in fields.items()), failed.alias("failed"))

    return let(let(F.coalesce(text, F.lit("")), of_text), flat)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failed): ``failed`` has bit b set where rule b fails."""
    return docs.select(F.col(f"`{id_col}`"), measurements(F.col(f"`{text_col}`")).alias("_m")).select(
        F.col(f"`{id_col}`"), *(F.col(f"_m.{c}").alias(c) for c in MEASURED), F.col("_m.failed").alias("failed")
    )


def violates(policy: Policy, failed: Column | str = "failed") -> Column:
    col = F.col(failed) if isinstance(failed, str) else failed
    return col.bitwiseAND(F.lit(policy.mask).cast("bigint")) != 0


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of ``policy`` does, from the ledger's bits alone.

    One row a rule: documents that fail it, those that fail nothing else of the
    policy (they would come back without the rule), and those that the whole
    policy rejects.  One aggregate of a few sums; no text is read.
    """
    masked = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    rules = [r for r in RULES if policy.mask >> r.bit & 1]
    sums = entries.agg(
        *(F.count_if(masked.bitwiseAND(F.lit(1 << r.bit).cast("bigint")) != 0).alias(f"f{r.bit}") for r in rules),
        *(F.count_if(masked == (1 << r.bit)).alias(f"o{r.bit}") for r in rules),
        F.count_if(masked != 0).alias("rejected"),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.col(f"f{r.bit}").alias("n_failed"),
                F.col(f"o{r.bit}").alias("n_only"),
                F.col("rejected").alias("n_rejected"),
            )
            for r in rules
        )
    )
    return sums.select(F.inline(rows))


def keep_good(docs: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``policy`` keeps, unchanged; map-only."""
    return docs.filter(~violates(policy, measurements(F.col(f"`{text_col}`"))["failed"]))
