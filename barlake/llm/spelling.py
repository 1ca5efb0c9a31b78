"""Spelling variants: words that differ by one letter, and the frequent word that a rare one stands for.

A dictionary is dealt into ranges of sorted words. Each range becomes a minimal acyclic automaton whose words are numbered
by a perfect hash (Daciuk et al. 2000, Mihov and Schulz 2004), once over the words and once over the words reversed. A word
is looked up by its first half, matched exactly, and its second half with one error; then by its second half in the
automata of reversed words, its first half with one error. One error leaves one half whole, so no near word is missed.
What both directions would find, the backward one leaves out.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Words of one automaton.
SHARD = 1 << 15
#: Counts that a task gathers before it passes them on, and characters of a text that are read at once.
GATHERED, SLICE = 1 << 18, 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LAST = "\U0010ffff"
LETTERS = "A-Za-zÀ-ÿ"


def _runs(text: str, shortest: int) -> Iterator[list[str]]:
    """Maximal runs of letters of at least that length, a slice of the text at a time; slices end between runs."""
    run, gap, at = re.compile(f"[{LETTERS}]{{{shortest},}}"), re.compile(f"[^{LETTERS}]"), 0
    while at < len(text):
        after = gap.search(text, min(len(text), at + SLICE))
        end = after.start() if after else len(text)
        yield run.findall(text, at, end)
        at = end + 1


def count_words(docs: DataFrame, shortest: int = 7, least: int = 2, slip: int = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters of at least ``shortest`` code points that occur ``least`` times or more.

    Only A-Z are lower-cased. Where ``slip`` divides the crc32 h of ``<doc_id>:<run>``, the run's code point h modulo its
    length is left out first; 0 leaves all runs as they are. Null texts have no words, a null doc_id counts as empty; equal
    rows count each. Tasks add up counts before the shuffle, so a frequent word is a few rows of it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                lead = zlib.crc32(f"{name.as_py() if name.is_valid else ''}:".encode())
                for runs in _runs(text.cast(pa.binary()).as_py().translate(_LOWER).decode(), shortest):
                    for run, n in Counter(runs).items():
                        if slip and (h := zlib.crc32(run.encode(), lead)) % slip == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < shortest:
                                continue
                        held[run] += n
                if len(held) >= GATHERED:
                    yield out()
        if held:
            yield out()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """Minimal acyclic automaton of sorted, distinct words; the number of a word is its place among them.

    A step from a state leads to a state and skips the words of the steps before it, so the number is the sum of what is skipped.
    """

    def __init__(self, words: list[str]) -> None:
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        sizes: list[int] = []
        known: dict[tuple, int] = {}
        open_steps: list[dict[str, int]] = [{}]
        open_final = [False]
        before = ""

        def close() -> int:
            """The last open state becomes one that is known or a new one."""
            steps, final = open_steps.pop(), open_final.pop()
            key = (final, *steps.items())
            if (state := known.get(key)) is None:
                state = known[key] = len(sizes)
                n, numbered = int(final), {}
                for c, to in steps.items():
                    numbered[c] = (to, n)
                    n += sizes[to]
                self.steps.append(numbered)
                self.final.append(final)
                sizes.append(n)
            return state

        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            for i in range(len(before), shared, -1):
                open_steps[i - 1][before[i - 1]] = close()
            open_steps.extend({} for _ in range(len(word) - shared))
            open_final.extend([False] * (len(word) - shared))
            open_final[-1] = True
            before = word
        for i in range(len(before), 0, -1):
            open_steps[i - 1][before[i - 1]] = close()
        self.root = close()

    def near(self, word: str, held: int) -> set[int]:
        """Numbers of the words that begin with the first ``held`` letters of the word and differ from it by one error after them."""
        steps, final, state, number, found, n = self.steps, self.final, self.root, 0, set(), len(word)

        def rest(state: int, number: int, i: int) -> None:
            while i < n:
                if (step := steps[state].get(word[i])) is None:
                    return
                state, skipped = step
                number += skipped
                i += 1
            if final[state]:
                found.add(number)

        for i in range(n + 1):
            if i >= held:
                c = word[i] if i < n else ""
                if c:
                    rest(state, number, i + 1)
                after = word[i + 1] if i + 1 < n else ""
                for other, (to, skipped) in steps[state].items():
                    ahead = steps[to]
                    if not c or c in ahead:
                        rest(to, number + skipped, i)
                    if c and other != c and (not after or after in ahead):
                        rest(to, number + skipped, i + 1)
            if i == n or (step := steps[state].get(word[i])) is None:
                return found
            state, skipped = step
            number += skipped
        return found


def _held(word: str, backward: bool) -> int:
    """Letters that are matched exactly: the first half, or (of a reversed word) what is left without it."""
    return len(word) - len(word) // 2 if backward else len(word) // 2


def _direction(vocab: DataFrame, words: int, backward: bool, ratio: int) -> DataFrame:
    """(word, n_near, form_n, form) of the words that have near ones in this direction."""
    name = "spelling-back" if backward else "spelling-on"
    key = (F.reverse("word") if backward else F.col("word")).alias("key")
    keys = vocab.select(key, "n")
    shards = table(keys.repartitionByRange(max(1, math.ceil(words / SHARD)), "key").withColumn("shard", F.spark_partition_id()), name)
    # a row a shard, of tens of thousands of words
    bounds = sorted((r.first, r.last, r.shard) for r in shards.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect())
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word goes to the shards that hold words which begin as it does."""
        for batch in batches:
            places, shard = [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                start = word[: _held(word, backward)]
                for k in range(bisect_left(lasts, start), bisect_right(firsts, start + _LAST)):
                    places.append(i)
                    shard.append(bounds[k][2])
            asked = batch.take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(shard, pa.int32())], ["key", "n", "shard"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of a shard come first, in order; then what is asked of it."""
        at, held, counts, automaton = None, [], [], None
        for batch in batches:
            out: list[tuple[str, int, int | None, str | None]] = []
            for shard, asks, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at:
                    at, held, counts, automaton = shard, [], [], None
                if not asks:
                    held.append(word)
                    counts.append(n)
                    continue
                automaton = automaton or Automaton(held)
                exact = _held(word, backward)
                found = automaton.near(word, exact)
                if backward:
                    found = {k for k in found if not held[k].endswith(word[exact:])}
                if not found:
                    continue
                # in sorted order of the words themselves, the first of the largest count
                n_near, turn = len(found), slice(None, None, -1 if backward else 1)
                form_n, form = min((-counts[k], held[k][turn]) for k in found)
                fits = -form_n >= ratio * n
                out.append((word[turn], n_near, -form_n if fits else None, form if fits else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER.types)], schema=_ANSWER)

    asked = keys.mapInArrow(ask, "key string, n long, shard int")
    met = shards.select("shard", F.lit(False).alias("asks"), "key", "n").union(asked.select("shard", F.lit(True), "key", "n"))
    dealt = met.repartition(max(1, len(bounds)), "shard").sortWithinPartitions("shard", "asks", "key")
    return dealt.mapInArrow(answer, "word string, n_near long, form_n long, form string")


_ANSWER = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a dictionary (word, n) of distinct, non-null words.

    ``n_near`` counts the words one inserted, deleted or replaced code point away. ``form`` is the one of the largest n (ties:
    the first in code-point order) if its n is at least ``ratio`` times the word's, else null; ``root`` is where forms lead to
    in the end, the word itself if it has none. Words of any length; an empty dictionary gives no rows.
    """
    if ratio < 2:
        raise ValueError("a ratio under 2 may lead round in circles")
    vocab = table(words.select("word", "n"), "spelling-words")
    size = vocab.agg(F.count("*").alias("words"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    found = _direction(vocab, size.words, False, ratio).union(_direction(vocab, size.words, True, ratio))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), "form"))).alias("best")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    rows = table(
        vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")), "spelling-forms"
    )
    roots = table(rows.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    # each form is `ratio` times as frequent, so chains are short; every round doubles what a root has behind it
    longest = math.log(size.most / max(size.least, 1), ratio) if size.words else 0
    for _ in range(math.ceil(math.log2(longest + 1)) if longest > 1 else 0):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = table(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
