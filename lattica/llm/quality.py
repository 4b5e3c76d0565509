"""Quality rules: statistics of whole texts, and decision lists learned from labelled statistics by sequential covering.

A list is ordered rules. Each rule is a conjunction of thresholds on named statistics and a verdict; the first rule that holds decides,
and a last default decides the rest. Rules are grown one threshold at a time by FOIL's information gain on two thirds of the sample,
pruned on the other third, and the rows they cover leave the sample. The learned list becomes one chained Spark expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, _BYTE, _bytes, mix64, slabs, SPACE, tidy, window_hashes, word_bounds, word_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_digits", "n_upper", "n_stops", "n_distinct")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True  # a lead byte stands for its character
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;,")] = True
WINDOW = 8


def _sum(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _per_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times each key occurs, True where it is the first of its kind)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    times, first = np.empty(len(s), np.int64), np.empty(len(s), bool)
    times[order], first[order] = np.bincount(group)[group] if len(s) else 0, new
    return times, first


def count(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of texts that lie one behind the other; a word ends with its text."""
    n = len(offsets) - 1
    # a line end between the texts keeps their words and lines apart
    shift = np.arange(n + 1)
    joined = np.full(len(raw) + n, 10, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    joined[np.arange(len(raw)) + owner] = raw
    at = offsets + shift
    starts, ends = word_bounds(joined)
    row = np.searchsorted(at, starts, "right") - 1
    hashes = word_hashes(joined, starts, ends)
    out = {"n_words": _per_row(row, n)}
    out["word_chars"] = _sum(((joined & 0xC0) != 0x80) & ~SPACE[joined], at)
    for name, kind in (("n_symbols", _SYMBOL), ("n_letters", _LETTER)):
        out[name] = _sum(kind[joined], at)
    out["n_digits"] = _sum((joined >= 48) & (joined <= 57), at)
    out["n_upper"] = _sum((joined >= 65) & (joined <= 90), at)
    out["n_stops"] = _sum(_STOP[joined], at)
    salt = mix64(np.arange(n, dtype=np.uint64) + np.uint64(1))
    out["n_distinct"] = _per_row(row[_repeats(hashes ^ salt[row])[1]], n)
    # lines, the line end excluded; empty ones and those of white space have no word
    breaks = np.flatnonzero(joined == 10)
    begin = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.empty(0, np.int64)
    has = np.searchsorted(starts, breaks) > np.searchsorted(starts, begin)
    begin, end = begin[has], breaks[has]
    line = np.searchsorted(at, begin, "right") - 1
    up, down = _bytes.upto(len(joined))
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * up, out=total[1:])
    keys = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)) ^ salt[line]
    out["n_lines"] = _per_row(line, n)
    out["n_dup_lines"] = out["n_lines"] - _per_row(line[_repeats(keys)[1]], n)
    # windows of words
    windows = window_hashes(hashes, WINDOW)
    inside = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :]) if len(windows) else np.empty(0, np.int64)
    twice = inside[_repeats(windows[inside] ^ salt[row[inside]])[0] > 1]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, np.minimum(twice + WINDOW, len(starts)), -1)
    out["n_repeat_words"] = _per_row(row[np.cumsum(cover[:-1]) > 0], n)
    return out


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the counts of COUNTS for every whole text, however long; null and empty texts count nothing, repeated rows count alike, an
    empty table gives an empty table. Other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slabs(batches):
            found = count(*buffers(rows.column(1)))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(found[c], pa.int64()) for c in COUNTS)], [key, *COUNTS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(tidy(run), f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios() -> dict[str, Column]:
    """The features that rules put thresholds on; zero where there is nothing to divide by."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return {
        "words": F.col("n_words").cast("double"), "chars_per_word": over("word_chars", "n_words"), "symbols_per_word": over("n_symbols", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_lines"), "repeat_share": over("n_repeat_words", "n_words"), "words_per_line": over("n_words", "n_lines"),
        "letter_share": over("n_letters", "word_chars"), "digit_share": over("n_digits", "word_chars"), "upper_share": over("n_upper", "word_chars"),
        "stops_per_word": over("n_stops", "n_words"), "distinct_share": over("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """Verdict of the rows for which every (feature, at_least, bound) holds: feature >= bound, or feature < bound."""

    tests: tuple[tuple[str, bool, float], ...]
    verdict: bool


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]
    default: bool

    def column(self) -> Column:
        """One ordered expression over the features of ratios()."""
        features, out = ratios(), None
        for rule in self.rules:
            holds = F.lit(True)
            for name, at_least, bound in rule.tests:
                holds = holds & ((features[name] >= bound) if at_least else (features[name] < bound))
            out = F.when(holds, rule.verdict) if out is None else out.when(holds, rule.verdict)
        return F.lit(self.default) if out is None else out.otherwise(self.default)

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out, free = np.full(len(x), self.default), np.ones(len(x), bool)
        for rule in self.rules:
            hit = free & _holds(rule.tests, x, names)
            out[hit], free = rule.verdict, free & ~hit
        return out


def _holds(tests, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, at_least, bound in tests:
        column = x[:, names.index(name)]
        hit &= (column >= bound) if at_least else (column < bound)
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int) -> list:
    """Adds the threshold of the greatest FOIL gain until the rule covers no good row or nothing is gained."""
    tests, hit = [], np.ones(len(x), bool)
    while len(tests) < most and (~bad[hit]).any():
        p, n = bad[hit].sum(), (~bad[hit]).sum()
        if not p:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for j, name in enumerate(names):
            order = np.argsort(x[hit, j], kind="stable")
            values, marks = x[hit, j][order], bad[hit][order]
            below_p, below_n = np.cumsum(marks)[:-1], np.cumsum(~marks)[:-1]
            cut = np.flatnonzero(values[1:] > values[:-1])
            for at_least, cp, cn in ((False, below_p[cut], below_n[cut]), (True, p - below_p[cut], n - below_n[cut])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - now), -1.0)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], (name, at_least, float((values[cut[i]] + values[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        hit = _holds(tests, x, names)
    return tests


def learn(x: np.ndarray, good: np.ndarray, names: list[str], seed: int = 7, precision: float = 0.9, least: int = 3, most_tests: int = 4, most_rules: int = 24) -> DecisionList:
    """Rules for the bad rows; the default keeps. A rule stays if, over all rows not yet covered, at least `precision` of those it
    covers are bad and there are at least `least`. Without good or without bad rows there are no rules and everything is kept."""
    good = good.astype(bool)
    left, rules, rng = np.arange(len(x)), [], np.random.default_rng(seed)
    while len(rules) < most_rules and (~good[left]).sum() >= least and good.any():
        shuffled = rng.permutation(left)
        cut = max(1, 2 * len(shuffled) // 3)
        grow, prune = shuffled[:cut], shuffled[cut:]
        tests = _grow(x[grow], ~good[grow], names, most_tests)

        def worth(t) -> float:
            hit = _holds(t, x[prune], names)
            p, n = (~good[prune][hit]).sum(), good[prune][hit].sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        hit = _holds(tests, x[left], names)
        bad_n, all_n = (~good[left][hit]).sum(), hit.sum()
        if not tests or bad_n < least or bad_n < precision * all_n:
            break
        rules.append(Rule(tuple(tests), False))
        left = left[~hit]
    return DecisionList(tuple(rules), True)


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> DecisionList:
    """Learns from at most `most` labelled documents, those with the smallest hashes of their ids; labels that are null or contradict one
    another are left out, as are base failures. Of rows with the same id one is learned from, that with the smallest counts. Empty
    tables give no rules."""
    names = list(ratios())
    sample = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    sample = sample.where("quality = other").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` pairs of numbers: bounded by the parameter, so they may be sent to every task
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = statistics(chosen).join(F.broadcast(sample), "doc_id").where(~base_failed()).select("doc_id", "quality", F.struct(*[c.alias(k) for k, c in ratios().items()]).alias("x"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).select("doc_id", "quality", "x.*").toPandas()
    rows = rows.sort_values("doc_id")
    return learn(rows[names].to_numpy(float), rows["quality"].to_numpy() > 0, names)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document, repeated rows included."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.column())
