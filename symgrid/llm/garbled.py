"""Problem 10: texts that were, wholly or in places, read with a wrong character encoding.

Lines of copies and revisions that are equal without their non-ASCII characters are near-twins. Their non-ASCII runs
are aligned character by character. What turns one run into the other is evidence: an encoding step (bytes of encoding
``right`` read as ``wrong``) or, where no step explains it, a mapping of characters as such. Steps and mappings with
enough evidence are learned and applied to all texts: steps to UTF-8 wherever characters form a valid sequence of a
known character, those between one-byte encodings by the frequent words that they bring out. A character that stands
for many different ones in its twins is a loss, as the replacement character is by definition; its texts are a class of
their own, and only a twin can restore them.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.sources.tables import keep

#: Encodings that are tried; of several that explain a pair of runs to UTF-8 the first is taken.
ONE_BYTE = ["cp1252", "mac_roman", "cp437", "cp1250", "cp1251", "koi8-r", "cp850", "cp866", "iso8859-2", "iso8859-5", "iso8859-15", "mac_cyrillic", "cp1257", "cp1254", "cp1253"]
#: Distinct pairs of runs that a step must explain, and their share of what the best step of its kind explains: unlike
#: twins, lines that are alike by chance grow in number with the corpus.
LEAST_EVIDENCE, EVIDENCE_SHARE = 2, 0.015
#: A word is known if at least this share of the documents, and 3 of them, has it. So there are at most
#: 1 / share times the words of an average document: the known words are broadcast.
WORD_SHARE = 1 / 2000
#: The same for single characters, of which there are no more than code points; box-drawing signs are in some 0.3 %.
CHARACTER_SHARE = 1 / 1000
#: Mappings that no step explains: least number of twin lines and share of all differing pairs of lines, so there are at
#: most 1 / share; share of what a sequence stands for that goes to one character; characters of the longest sequence.
LEAST_MAPPED, MAPPED_SHARE, CLEAR_SHARE, LONGEST_MAPPED = 5, 1 / 2000, 0.9, 4
#: Different characters that one stands for which is a loss.
LEAST_LOST = 4
#: ASCII characters that tell a line's twins; a shorter line is told along with the characters before it.
LEAST_LINE = 20
#: Times that the word which a step brings out must be as frequent as the word as it stands.
CLEARLY = 5
LOST = "\ufffd"

_LINES = regex.compile(r"[^\n]*[^\x00-\x7f\n][^\n]*").finditer
_RUNS = regex.compile(r"[^\x00-\x7f]+")
_WORDS = regex.compile(r"[A-Za-z\x80-\U0010ffff]*[\x80-\U0010ffff][A-Za-z\x80-\U0010ffff]*").findall
_VERB = regex.compile(r"\\verb\*?([^A-Za-z\s*])(?:(?!\1)[^\n])*\1").sub


class Step(NamedTuple):
    """Text of encoding ``right`` that was read as ``wrong``."""

    wrong: str
    right: str


@functools.cache
def _table(name: str) -> dict[str, int]:
    """Byte of each character; bytes without one stand for the control character of that number, as readers do."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    for b in range(128, 160):  # some readers keep control characters
        table.setdefault(chr(b), b)
    return table


@functools.cache
def _sequences(wrong: str) -> regex.Pattern:
    """UTF-8 sequences of 2 to 4 bytes as they look when read in a one-byte encoding."""
    of = lambda lo, hi: "[" + "".join(regex.escape(c) for c, b in _table(wrong).items() if lo <= b <= hi) + "]"
    rest = of(0x80, 0xBF)
    return regex.compile(f"{of(0xC2, 0xDF)}{rest}|{of(0xE0, 0xEF)}{rest}{{2}}|{of(0xF0, 0xF4)}{rest}{{3}}")


def _undo(found: regex.Match, table: dict[str, int]) -> str:
    try:
        return bytes([table[c] for c in found.group()]).decode("utf-8")
    except UnicodeDecodeError:
        return found.group()


def repair(text: str, step: Step) -> str:
    """The text with a step undone, wherever it can be."""
    table = _table(step.wrong)
    if step.right == "utf-8":
        return _sequences(step.wrong).sub(lambda m: _undo(m, table), text)
    back = _back(step)
    return "".join([back.get(c, c) for c in text])


@functools.cache
def _back(step: Step) -> dict[str, str]:
    right = {b: c for c, b in _table(step.right).items() if not 0x80 <= ord(c) < 0xA0}
    return {c: right[b] for c, b in _table(step.wrong).items() if b in right and right[b] != c}


@functools.cache
def _pairs_of_characters() -> dict[tuple[str, str], int]:
    """Of each pair of characters the steps between one-byte encodings that turn the first into the second, as bits."""
    out: dict[tuple[str, str], int] = defaultdict(int)
    for i, step in enumerate(_one_byte_steps()):
        for g, c in _back(step).items():
            out[g, c] |= 1 << i
    return dict(out)


@functools.cache
def _one_byte_steps() -> list[Step]:
    return [Step(wrong, right) for wrong in ONE_BYTE for right in ONE_BYTE if wrong != right]


def explain(garbled: str, clean: str) -> list[Step]:
    """The step that turns ``garbled`` into ``clean`` all over, if any: the first one to UTF-8, with up to two repetitions.

    Else the first between one-byte encodings that turns each character into the one it is aligned with. Encodings that
    differ in few characters only would explain the same pairs; one of them is enough.
    """
    for wrong in ONE_BYTE:
        step, text = Step(wrong, "utf-8"), garbled
        for _ in range(3):
            text, before = repair(text, step), text
            if text == before:
                break
            if text == clean:
                return [step]
    if len(garbled) != len(clean):
        return []
    pairs, bits = _pairs_of_characters(), -1
    for pair in zip(garbled, clean):
        bits &= pairs.get(pair, 0)
        if not bits:
            return []
    return [_one_byte_steps()[(bits & -bits).bit_length() - 1]]


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The sequence and the single character that it stands for; nothing for longer runs.

    Lines that consist of words without ASCII letters are alike by chance, so their characters say nothing.
    """
    return [(garbled, clean)] if len(clean) == 1 and len(garbled) <= LONGEST_MAPPED else []


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _word_key(word: str) -> str:
    """A word as it is counted: a long one by its hash."""
    return word if len(word) < 64 else f"{word[:8]}\x00{_key(word)}"


def _twin_keys(text: str) -> Iterator[tuple[int, str, str, list[str]]]:
    """(key, wider key or '', line, runs) of each line with non-ASCII characters; the key is that of the line without them."""
    for m in _LINES(text):
        line = m.group().strip()
        runs = _RUNS.findall(line)
        rest = _RUNS.sub("\x01", line)
        if len(rest) - len(runs) < LEAST_LINE:
            before = _RUNS.sub("\x01", text[max(0, m.start() - 3 * LEAST_LINE) : m.start()])
            rest = f"{before}\x02{rest}"
            if len(rest) - rest.count("\x01") < LEAST_LINE:
                continue
        yield _key(rest), rest, line, runs


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, item, n): lines by their ASCII part with their runs; documents by word and by character."""
    lines: Counter = Counter()
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    docs = 0

    def flush() -> pa.RecordBatch:
        rows = [("line", k, i, n) for (k, i), n in lines.items()] + [(kind, 0, i, n) for kind, c in zip(("word", "character"), seen) for i, n in c.items()] + [("documents", 0, "", docs)]
        for c in (lines, *seen):
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["kind", "key", "item", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            docs += 1
            if not text or text.isascii():
                continue
            text = unicodedata.normalize("NFC", text)
            for key, rest, _, runs in _twin_keys(text):
                together = "\x00".join(runs)
                lines[key, together] += 1
                if len(together) > 2 * len(runs) + LEAST_LINE // 2:
                    # whole words: many lines have the same ASCII rest; one-byte steps keep lengths, which tells twins
                    lines[_key(rest + "\x00" + ",".join([str(len(r)) for r in runs])), together] += 1
            seen[0].update({_word_key(w) for w in set(_WORDS(text))})
            seen[1].update({c for w in set(_RUNS.findall(text)) for c in w})
        if len(lines) + len(seen[0]) > 200_000:
            yield flush()
            docs = 0
    yield flush()


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of aligned pairs of runs, both ways round: the steps that explain them, or else what their characters map to."""
    for b in batches:
        rows = []
        for x, y, n in zip(*[col.to_pylist() for col in b.columns]):
            steps = [(s.wrong, s.right, g, c, n) for g, c in ((x, y), (y, x)) for s in explain(g, c)]
            rows += steps or [("", "", g, c, n) for pair in ((x, y), (y, x)) for g, c in align(*pair)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["wrong", "right", "garbled", "clean", "n"])


class Knowledge(NamedTuple):
    """What is learned from all documents.

    Sizes are bounded: steps by the encodings, words by ``WORD_SHARE``, characters by Unicode, mappings by ``MAPPED_SHARE``.
    """

    steps: list[Step]
    words: dict[str, int]
    characters: frozenset[str]
    mappings: dict[str, str]
    lost: frozenset[str]


def gather(documents: DataFrame, text: str = "text") -> DataFrame:
    """Lines by their ASCII part, words and characters of all documents, kept in the shared folder."""
    return keep(documents.select(text).mapInArrow(_gather, "kind string, key long, item string, n long"), "gathered")


def _lines(got: DataFrame) -> DataFrame:
    return got.where(F.col("kind") == "line").groupBy("key", "item").agg(F.sum("n").alias("n"))


def learn(documents: DataFrame, text: str = "text", got: DataFrame | None = None) -> Knowledge:
    """Steps, mappings, losses, known words and known characters of the texts. Null, empty and blank texts count as documents without words."""
    got = gather(documents, text) if got is None else got
    n_docs = got.where(F.col("kind") == "documents").agg(F.sum("n")).first()[0] or 0
    lines = _lines(got)
    best = lines.groupBy("key").agg(F.max(F.struct("n", "item")).alias("best"), F.count(F.lit(1)).alias("variants")).where(F.col("variants") > 1).select("key", F.col("best.item").alias("best"))
    # each variant is aligned with the most frequent one of its twins: as many pairs as lines
    twins = lines.join(best, "key").where(F.col("item") != F.col("best"))
    x, y = F.split("best", "\x00"), F.split("item", "\x00")
    pairs = twins.where(F.size(x) == F.size(y)).select(F.explode(F.arrays_zip(x.alias("x"), y.alias("y"))).alias("p")).select("p.x", "p.y").where(F.col("x") != F.col("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    # few bytes but much work a pair: spread by count, which adaptive execution would not do
    spread = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keep(pairs.repartition(spread).mapInArrow(_evidence, "wrong string, right string, garbled string, clean string, n long"), "evidence")
    common = got.where(F.col("kind") == "character").groupBy(F.col("item").alias("c")).agg(F.sum("n").alias("n"))
    seen = {r.c: r.n for r in common.collect()}  # at most one row for each code point
    known = {c for c, n in seen.items() if n >= max(3, n_docs * CHARACTER_SHARE)}
    steps, clean, wrong = _learned_steps(found.where(F.col("wrong") != ""), seen)
    mappings, lost = _learned_mappings(found.where(F.col("wrong") == ""), seen)
    words = got.where(F.col("kind") == "word").groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, n_docs * WORD_SHARE)).collect()
    return Knowledge(steps, {r.item: r.n for r in words}, frozenset(known | (clean - wrong)), mappings, lost)


def _learned_steps(found: DataFrame, seen: dict[str, int]) -> tuple[list[Step], set[str], set[str]]:
    """Steps with enough evidence, and the characters that steps to UTF-8 gave and took."""
    # evidence is summed by step and characters, which bounds what the driver gets by the encodings' characters
    parts = F.explode(F.arrays_zip(F.split("garbled", "").alias("g"), F.split("clean", "").alias("c"))).alias("p")
    by_step = found.select("wrong", "right", parts, "garbled", "clean").groupBy("wrong", "right").agg(F.countDistinct("garbled", "clean").alias("n"), F.collect_set(F.col("p.g")).alias("g"), F.collect_set(F.col("p.c")).alias("c")).collect()
    steps, clean, wrong = [], set(), set()
    most = {kind: max([r.n for r in by_step if (r.right == "utf-8") == kind], default=0) for kind in (True, False)}
    rare = lambda cs: sum(math.log(1 + seen.get(x, 0)) for x in cs if x) / max(1, len([x for x in cs if x]))
    for r in by_step:
        step = Step(r.wrong, r.right)
        if r.n < max(LEAST_EVIDENCE, EVIDENCE_SHARE * most[step.right == "utf-8"]):
            continue
        if step.right == "utf-8":
            clean |= {x for x in r.c if x}
            wrong |= {x for x in r.g if x}
        elif rare(r.g) >= rare(r.c):  # the garbled side has characters that the corpus hardly has
            continue
        steps.append((step, r.n))
    # those to UTF-8 in the order of the list; of the others the one with most evidence first
    steps.sort(key=lambda x: (x[0].right != "utf-8", 0 if x[0].right == "utf-8" else -x[1], ONE_BYTE.index(x[0].wrong), x[0].right))
    return [s for s, _ in steps], clean, wrong


def _learned_mappings(found: DataFrame, seen: dict[str, int]) -> tuple[dict[str, str], frozenset[str]]:
    """Sequences that mostly stand for one character, and characters that stand for many, both much rarer than what they stand for."""
    total = found.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_MAPPED, MAPPED_SHARE * total)
    to = found.groupBy("garbled", "clean").agg(F.sum("n").alias("n"))
    kinds = F.filter(F.collect_list(F.struct("n", "clean")), lambda x: (x["n"] > 1) & (F.length(x["clean"]) == 1))
    by = to.groupBy("garbled").agg(F.sum("n").alias("all"), F.max(F.struct("n", "clean")).alias("best"), kinds.alias("kinds"))
    rows = by.where(F.col("all") >= least).collect()  # at most 1 / MAPPED_SHARE
    rarer = lambda g, c: CLEARLY * min(seen.get(x, 0) for x in g) <= seen.get(c, 0)
    clear = lambda r: r.best.n >= CLEAR_SHARE * r["all"]
    mappings = {r.garbled: r.best.clean for r in rows if clear(r) and len(r.best.clean) == 1 and rarer(r.garbled, r.best.clean)}
    stands = lambda r: sum(rarer(r.garbled, k.clean) for k in r.kinds)
    lost = {r.garbled for r in rows if len(r.garbled) == 1 and not clear(r) and stands(r) >= LEAST_LOST}
    return mappings, frozenset(lost | {LOST})


def _cyrillic(s: str) -> bool:
    return all("\u0400" <= c <= "\u052f" for c in s)


class Detector:
    """Tells garbled texts and restores them, by learned steps."""

    def __init__(self, known: Knowledge) -> None:
        self.known = known
        self.to_utf8 = [s for s in known.steps if s.right == "utf-8"]
        self.one_byte = [s for s in known.steps if s.right != "utf-8"]
        self.lossy = regex.compile("[" + "".join(map(regex.escape, sorted(known.lost))) + "]").search
        longest = sorted(known.mappings, key=lambda x: (-len(x), x))
        self.mapped = regex.compile("|".join(map(regex.escape, longest))) if longest else None

    def _map(self, run: str) -> str:
        """A run with learned mappings applied."""
        return self.mapped.sub(lambda m: self.known.mappings[m.group()], run) if self.mapped else run

    def _whole(self, run: str, step: Step) -> bool:
        """Whether nothing but sequences makes up a run."""
        return not _sequences(step.wrong).sub("", run)

    def _fix(self, run: str, depth: int = 3) -> str:
        """A run with its sequences undone as often as that leads to known characters; unchanged if it doesn't."""
        for step in self.to_utf8:
            hits = list(_sequences(step.wrong).finditer(run))
            if not hits:
                continue
            table = _table(step.wrong)
            if any(_cyrillic(h.group()) for h in hits) and not self._whole(run, step):
                continue  # letters of a script whose words may contain such pairs
            undone = [(h, _undo(h, table)) for h in hits]
            once = _sequences(step.wrong).sub(lambda m: _undo(m, table), run)
            if once == run:
                continue
            if depth > 1 and (more := self._fix(once, depth - 1)) != once:
                return more
            if any(u in self.known.characters and u != h.group() and unicodedata.category(u) not in ("Sk", "Cc", "Cf") for h, u in undone):
                return once
        return run

    def _words(self, text: str) -> Step | None:
        """Of the steps between one-byte encodings that bring out two known words or more the one that brings out most."""
        if not self.one_byte:
            return None
        words = {w for w in _WORDS(text) if len(w) > 1}
        best, most = None, 1
        for step in self.one_byte:
            if (n := sum(self._better(w, step) for w in words)) > most:
                best, most = step, n
        return best

    def _better(self, word: str, step: Step) -> bool:
        """Whether a step makes a word one that is ``CLEARLY`` times as frequent. Garbled words may be known themselves."""
        other = unicodedata.normalize("NFC", repair(word, step))
        words = self.known.words
        return other != word and words.get(_word_key(other), 0) > CLEARLY * words.get(_word_key(word), 0)

    def garbled(self, text: str) -> str | None:
        """lost for a text with a lost character, step for one that steps or mappings restore, None for one in order."""
        if not text or text.isascii():
            return None
        text = _VERB(" ", text)
        if self.lossy(text):
            return "lost"
        runs = set(_RUNS.findall(text))
        if any(self._fix(r) != r or self._map(r) != r for r in runs) or self._words(unicodedata.normalize("NFC", text)) is not None:
            return "step"
        return None

    def restore(self, text: str) -> str:
        """The text with all learned steps undone outside ``\\verb``; lost characters stay."""
        held: list[str] = []
        text = _VERB(lambda m: held.append(m.group()) or f"\x00{len(held) - 1}\x00", text)
        text = _RUNS.sub(lambda m: self._map(self._fix(m.group())), text)
        if step := self._words(unicodedata.normalize("NFC", text)):
            # by line: where a step helps no word and some word is known as it stands, nothing is changed
            lines = text.split("\n")
            helps = [[self._better(unicodedata.normalize("NFC", w), step) for w in _WORDS(x)] for x in lines]
            plain = [any(len(w) > 1 and _word_key(w) in self.known.words for w in _WORDS(x)) for x in lines]
            text = "\n".join(repair(x, step) if any(h) or (h and not p) else x for x, h, p in zip(lines, helps, plain))
        return regex.sub("\x00(\\d+)\x00", lambda m: held[int(m.group(1))], text)


def _lost_lines(lost: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, key, line, runs) of the lines with a lost character of texts (id, text)."""
    has = regex.compile("[" + "".join(map(regex.escape, sorted(lost))) + "]").search

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, key, line, "\x00".join(runs)) for i, t in zip(*[c.to_pylist() for c in b.columns]) for key, _, line, runs in _twin_keys(unicodedata.normalize("NFC", t)) if has(line)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["id", "key", "line", "runs"])

    return run


def patch(line: str, runs: str, twin: str, lost: frozenset[str]) -> str:
    """A line with the runs of its twin where its own have lost characters; unchanged if the runs don't correspond."""
    own, other = runs.split("\x00"), twin.split("\x00")
    if len(own) != len(other) or any(a != b for a, b in zip(own, other) if not lost & set(a)):
        return line
    turn = iter(other)
    return _RUNS.sub(lambda m: next(turn), line)


def _from_twins(texts: DataFrame, got: DataFrame, lost: frozenset[str]) -> DataFrame:
    """(id, was, now) of lines of texts (id, text) that a twin without lost characters restores."""
    lines = texts.mapInArrow(_lost_lines(lost), "id long, key long, line string, runs string")
    has = F.lit(False)
    for c in sorted(lost):
        has |= F.col("item").contains(c)
    best = _lines(got).where(~has).groupBy("key").agg(F.max(F.struct("n", "item")).alias("b")).select("key", F.col("b.item").alias("twin"))
    # a key's twin is one row; the lines are few, but the planner can't know how many Python gives out
    both = lines.hint("merge").join(best, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, line, now) for i, line, runs, twin in zip(*[c.to_pylist() for c in b.columns]) if (now := patch(line, runs, twin, lost)) != line]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["id", "was", "now"])

    return both.select("id", "line", "runs", "twin").mapInArrow(run, "id long, was string, now string")


def _patched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, text, was, now) with their lines replaced."""
    for b in batches:
        out = []
        for text, was, now in zip(*[c.to_pylist() for c in b.columns[1:]]):
            turn = dict(zip(was, now))
            lines = [(line, unicodedata.normalize("NFC", line.strip())) for line in text.split("\n")]
            out.append("\n".join(line.replace(line.strip(), turn[k]) if k in turn else line for line, k in lines))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])


def find(documents: DataFrame, known: Knowledge | None = None, key: str = "doc_id", text: str = "text", restored: bool = False) -> DataFrame:
    """(key[, kind, restored]) of the rows whose text is garbled somewhere; null, empty and ASCII texts never are.

    kind is lost for texts with lost characters, else step. Sequences inside ``\\verb|…|`` are quotations. Lost characters
    are restored from twin lines where there are any, and stay elsewhere. Repeated rows give repeated results, extra
    columns are dropped, an empty table gives no rows. Two passes over the texts, no shuffle of whole texts but of those
    with lost characters.
    """
    got = gather(documents, text) if known is None or restored else None
    known = known or learn(documents, text, got)
    shared = documents.sparkSession.sparkContext.broadcast(known)
    type_ = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Detector(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            kinds = [d.garbled(t) if t else None for t in texts]
            at = [i for i, k in enumerate(kinds) if k]
            if at:
                columns = [b.column(0).take(pa.array(at))]
                if restored:
                    columns += [pa.array([kinds[i] for i in at]), pa.array([d.restore(texts[i]) for i in at], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "kind", "restored"][: len(columns)])

    found = documents.select(key, text).mapInArrow(run, f"k {type_}" + ", kind string, restored string" * restored).withColumnRenamed("k", key)
    if not restored:
        return found
    found = keep(found, "restored").withColumn("id", F.monotonically_increasing_id())
    found = keep(found, "restored")
    lost = found.where(F.col("kind") == "lost").select("id", F.col("restored").alias("text"))
    lines = _from_twins(lost, got, known.lost).groupBy("id").agg(F.collect_list("was").alias("was"), F.collect_list("now").alias("now"))
    better = lost.join(lines.hint("merge"), "id").mapInArrow(_patched, "id long, text string")
    return found.join(better.hint("merge"), "id", "left").select(key, "kind", F.coalesce("text", "restored").alias("restored"))
