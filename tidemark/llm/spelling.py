"""Spelling variants: words one edit apart, found by composing automata.

The vocabulary is counted over all documents.  Pairs of words that differ by one
inserted, deleted or replaced code point are the pairs accepted by the composition of
the minimised vocabulary acceptor, a one-edit transducer and the acceptor again.  A
composed state is (state, edits so far, state); as long as nothing is edited both
states are the same, and after the edit the rest of both words must be equal, so it is
a common word of two right languages, worked out once for each acceptor state.

The composition is cut by its initial state.  A word is sent to the part of its stem,
and the acceptor of that part starts behind the stem, where the two words of a pair have
read the same code points.  A pair whose edit lies inside the stem has an equal ending
instead and meets in the part of its reversed stem.  Stems have three code points, and
one more as long as more than ``CROWDED`` words share them, so no part grows with a
crowded beginning or ending.  A pair edited inside both stems starts behind the edit:
the part is its beginning and ending together, which at most one word per letter shares.
Each pair is enumerated once, in the first of the three ways that has it.

Rows: a null text has no words; a row without id has no hash, so nothing is deleted
in it; repeated rows count as often as they stand there; texts of any length are read
whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks
from tidemark.llm.tables import written

#: Runs of A-Z, a-z and U+00C0 to U+00FF, as UTF-8 with A-Z folded.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])++")
_FOLD = bytes(blocks.FOLD)

STEM = 3
CROWDED = 4_000
#: Words a task holds beside a crowded part.
PART_WORDS = 20_000
#: Distinct words a counting task holds before it hands them on.
HELD = 200_000

_BEGINNING, _ENDING, _BOTH = 0, 1, 2


def counted(docs: DataFrame, shortest: int = 6, least: int = 5, one_in: int = 199) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z folded, that occur ``least`` times.

    Where ``one_in`` divides the crc32 h of ``<doc_id>:<run>``, the run loses its
    code point h % length first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for block in blocks.cut(batches):
            texts = block.column("text").cast(pa.binary()).to_pylist()
            for doc_id, text in zip(block.column("doc_id").to_pylist(), texts, strict=True):
                if not text:
                    continue
                begin = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
                for run, n in Counter(_RUN.findall(text.translate(_FOLD))).items():
                    if len(run) < shortest:
                        continue
                    h = 1 if begin is None else zlib.crc32(run, begin)
                    if h % one_in == 0:
                        letters = run.decode()
                        at = h % len(letters)
                        run = (letters[:at] + letters[at + 1 :]).encode()
                    if len(run) - run.count(b"\xc3") >= shortest:
                        tally[run] += n
            if len(tally) > HELD:
                yield _counts(tally)
                tally.clear()
        yield _counts(tally)

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counts(tally: Counter) -> pa.RecordBatch:
    words = pa.array(list(tally), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(tally.values(), pa.int64())], names=["word", "n"])


class Acceptor:
    """The minimal acyclic automaton of a set of words.

    ``arcs[q]`` maps letters to states, ``final[q]`` tells whether a word ends in q.
    Words are added in order; states behind the last common beginning are complete
    and are replaced by equal states that are there already.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self._known: dict[tuple, int] = {}
        path, before = [0], ""
        for word in words:
            shared = _shared(before, word)
            self._complete(path, before, shared)
            for letter in word[shared:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            before = word
        self._complete(path, before, 0)
        self._known.clear()
        self._tails: dict[int, list[tuple[str, str]]] = {}

    def _complete(self, path: list[int], word: str, depth: int) -> None:
        while len(path) - 1 > depth:
            state, letter = path.pop(), word[len(path) - 1]
            same = self._known.setdefault((self.final[state], *self.arcs[state].items()), state)
            if same != state:
                self.arcs[path[-1]][letter] = same
                self.arcs[state] = {}

    def after(self, stem: str) -> int:
        state = 0
        for letter in stem:
            state = self.arcs[state][letter]
        return state

    def _common(self, one: int, two: int) -> list[str]:
        """The words that lead from both states to final ones."""
        out, path, walk = [], [], [iter(((None, one, two),))]
        while walk:
            step = next(walk[-1], None)
            if step is None:
                walk.pop()
                if path:
                    path.pop()
                continue
            letter, a, b = step
            if letter is not None:
                path.append(letter)
            if self.final[a] and self.final[b]:
                out.append("".join(path))
            few, many = self.arcs[a], self.arcs[b]
            if len(few) > len(many):
                few, many = many, few
            walk.append(iter([(c, few[c], many[c]) for c in few if c in many]))
            if letter is None:
                walk.pop(0)
        return out

    def tails(self, state: int) -> list[tuple[str, str]]:
        """What two words one edit apart may go on with where they begin to differ."""
        found = self._tails.get(state)
        if found is None:
            found, arcs = [], sorted(self.arcs[state].items())
            for i, (c, behind) in enumerate(arcs):
                # Replaced: c and d, then the same.  Inserted: c, then what the other has here.
                found += [(c + rest, d + rest) for d, other in arcs[i + 1 :] for rest in self._common(behind, other)]
                found += [(rest, c + rest) for rest in self._common(state, behind) if not rest.startswith(c)]
            self._tails[state] = found
        return found

    def pairs(self, stem: str) -> Iterator[tuple[str, str]]:
        """The accepted pairs of the composition started at (stem, no edit, stem)."""
        path, walk = [stem], [iter(((None, self.after(stem)),))]
        while walk:
            step = next(walk[-1], None)
            if step is None:
                walk.pop()
                path.pop()
                continue
            letter, state = step
            path.append(letter or "")
            tails = self.tails(state)
            if tails:
                begin = "".join(path)
                for one, two in tails:
                    yield begin + one, begin + two
            walk.append(iter(self.arcs[state].items()))


def _shared(one: str, two: str) -> int:
    """How many code points two words begin with in common."""
    n = 0
    for a, b in zip(one, two):  # noqa: B905
        if a != b:
            break
        n += 1
    return n


def _stems(words: DataFrame, column: str, name: str) -> DataFrame:
    """word and the length of its stem: longer than the word if all its beginnings are crowded."""
    longer = F.expr(f"IF(length({column}) >= {STEM}, sequence({STEM}, length({column})), array())")
    each = words.select("word", F.explode(longer).alias("depth"), F.col(column).alias("letters")).select(
        "word", "depth", F.expr("substring(letters, 1, depth)").alias("stem")
    )
    crowded = each.groupBy("stem").agg(F.count("*").alias("words")).where(F.col("words") > CROWDED)
    deepest = each.join(crowded, "stem", "left_semi").groupBy("word").agg((F.max("depth") + 1).alias(name))
    return words.join(deepest, "word", "left").withColumn(name, F.coalesce(name, F.lit(STEM)))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n: every two different words of ``vocabulary`` (word, n; distinct)
    that are one edit apart, in both orders, once each."""
    table = written(vocabulary.select("word", "n"), "vocabulary")
    parts = max(1, -(-table.count() // PART_WORDS))
    known = _stems(table.withColumn("reversed", F.reverse("word")), "word", "head")
    known = written(_stems(known, "reversed", "tail").drop("reversed"), "stems")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, stem, row = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("word", "head", "tail")]
            for i, (word, head, tail) in enumerate(zip(*columns, strict=True)):
                if head <= len(word):
                    kind.append(_BEGINNING), stem.append(word[:head]), row.append(i)
                if tail <= len(word):
                    kind.append(_ENDING), stem.append(word[: -tail - 1 : -1]), row.append(i)
                for cut in range(min(head, len(word) + 1)):
                    # A letter replaced or deleted at the cut, and one inserted there.
                    for rest in (word[cut + 1 :], word[cut:]) if cut < len(word) else ("",):
                        if len(rest) < tail:
                            kind.append(_BOTH), stem.append(f"{cut} {word[:cut]}{rest}"), row.append(i)
            some = batch.take(pa.array(row, pa.int32()))
            crc = [zlib.crc32(s.encode()) for s in stem]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(crc, np.int64) % parts, pa.int32()), pa.array(kind, pa.int32()), pa.array(stem, pa.string()), *some.columns],
                names=["part", "kind", "stem", *batch.schema.names],
            )

    def compose(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        rows = table.select(["stem", "word", "n", "head", "tail"]).to_pylist()
        known = {r["word"]: r for r in rows}
        found = _edited_inside(rows) if kind == _BOTH else _composed(rows, reverse=kind == _ENDING)
        both = [p for one, two in found for p in ((one, two), (two, one))]
        return pa.table({
            "word": pa.array([p[0] for p in both], pa.string()),
            "near": pa.array([p[1] for p in both], pa.string()),
            "near_n": pa.array([known[p[1]]["n"] for p in both], pa.int64()),
        })

    dealt = known.select("word", "n", "head", "tail").mapInArrow(
        deal, "part int, kind int, stem string, word string, n long, head int, tail int"
    )
    return dealt.groupBy("kind", "part").applyInArrow(compose, "word string, near string, near_n long")


def _composed(rows: list[dict], reverse: bool) -> Iterator[tuple[str, str]]:
    heads = {r["word"]: r["head"] for r in rows}
    acceptor = Acceptor(sorted(w[::-1] for w in heads) if reverse else sorted(heads))
    for stem in sorted({r["stem"] for r in rows}):
        for one, two in acceptor.pairs(stem):
            if not reverse:
                yield one, two
            elif _shared(one[::-1], two[::-1]) < heads[one[::-1]]:
                # Otherwise the beginnings had them.
                yield one[::-1], two[::-1]


def _edited_inside(rows: list[dict]) -> Iterator[tuple[str, str]]:
    """Pairs that agree in all but the edit, where beginning and ending are both crowded."""
    groups: dict[str, set[str]] = {}
    tails = {}
    for r in rows:
        groups.setdefault(r["stem"], set()).add(r["word"])
        tails[r["word"]] = r["tail"]
    for stem, words in groups.items():
        cut = int(stem.split(" ", 1)[0])
        ordered = sorted(words)
        for i, one in enumerate(ordered):
            for two in ordered[i + 1 :]:
                # The edit is where they begin to differ, and no part of endings has both.
                if _shared(one, two) == cut and _shared(one[::-1], two[::-1]) < tails[one]:
                    yield one, two


def forms(vocabulary: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``vocabulary``.

    Along forms n grows by the ratio, so chains are short; roots are found by
    joining the table of forms with itself until nothing moves.
    """
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    found = written(
        vocabulary.select("word", "n").join(best, "word", "left")
        .withColumn("good", F.coalesce(-F.col("best.minus") >= ratio * F.col("n"), F.lit(False)))
        .select(
            "word", F.when(F.col("good"), F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("good"), -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    now = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(
            now.join(ahead, "root", "left")
            .select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots",
        )
        if not now.where("moved").limit(1).count():
            break
        now = now.drop("moved")
    return found.join(now.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, one_in: int = 199, ratio: int = 5) -> DataFrame:
    """The spelling forms and roots of all words of ``docs``."""
    vocabulary = written(counted(docs, shortest, least, one_in), "words")
    return forms(vocabulary, near_pairs(vocabulary), ratio)
