"""Freely typed names mapped to the entries of a reference list.

A value is cut down to its leading name and normalised; if that is no entry as it stands, an inverted index of its
character n-grams yields candidates, which are scored by weighted cosine. Candidates above a threshold are checked
letter by letter; the one with the fewest slips, then the highest cosine, is accepted if it is ahead of the
runner-up by a margin. A list too long for one index is taken in blocks with common weights, and the order, the
margin and the runner-up are those of the whole list.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrow_type, columns, no_clash, quoted, spec

#: Least cosine of a candidate, most slips of the pen in an accepted name, cosine lead that settles equal slips.
THRESHOLD, SLIPS, MARGIN = 0.2, 2, 0.02
#: Entries of the list that go to the workers at once; a longer list is taken in blocks.
BLOCK_ENTRIES = 200_000
#: Normalised names whose result a worker keeps; (name, entry) sums that are added up at once.
KEPT, CELLS = 1 << 18, 1 << 17
#: Words around a name that are none: forms, salts, routes, frequency, units, marks.
NOISE = frozenset("""
    tab tabs tablet tablets cap caps capsule capsules injection inj oral solution soln suspension syrup cream ointment gel patch
    chewable er sr xr xl ir dr la cr odt extended release delayed immediate film coated drops spray inhaler powder
    hcl hydrochloride sodium maleate tartrate sulfate sulphate potassium calcium acetate citrate phosphate mesylate besylate succinate fumarate bromide chloride
    mg mgs mcg ug g gm gms gram grams milligram milligrams microgram micrograms ml meq milliequivalents unit units iu u ku int usp million thousand mio
    daily once twice three four two times time every morning evening night bedtime hour hours hr h q bid tid qid qd qhs prn at in the per day week weekly x
    generic brand rx the of and with po by mouth as needed i d r tm
""".split())
#: Sounds written in more than one way, brought to one.
SOUNDS = (("ph", "f"), ("ks", "x"), ("ck", "k"), ("y", "i"), ("w", "v"), ("k", "c"), ("z", "c"))

_WORD = re.compile(r"[^\W\d_]+")
_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|[™®©]")


def letters(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def words_of(text: str) -> list[str]:
    """The words of a value without what is in brackets, numbers and marks."""
    return _WORD.findall(letters(_BRACKETS.sub(" ", text)))


def normal(text: str) -> str:
    """The words of an entry."""
    return " ".join(_WORD.findall(letters(text)))


class Words:
    """What the entries of the whole list say about their words: entries of several words, and words that may go on a name."""

    def __init__(self, keys: Iterable[str]):
        split = [tuple(_WORD.findall(letters(k))) for k in keys]
        self.whole = {w: " ".join(w) for w in split if len(w) > 1 or (w and w[0] in NOISE)}
        self.longest = max(map(len, self.whole), default=1)
        self.later = frozenset(x for w in split for x in w[1:])
        self.known: dict[str, bool] = {}

    def extends(self, word: str) -> bool:
        """Whether a word is, but for one slip, a later word of an entry."""
        if word in self.later:
            return True
        if word in NOISE or len(word) < 4:
            return False
        if word not in self.known:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[word] = any(abs(len(s) - len(word)) <= 1 and edits(word, s, 1) <= 1 for s in self.later)
        return self.known[word]

    def leading(self, text: str) -> str:
        """The leading name of a typed value: the longest entry that stands there as it is, else the first word that is no
        noise with those that go on after it as in an entry."""
        words = words_of(text)
        for i, w in enumerate(words):
            for n in range(min(self.longest, len(words) - i), 0, -1):
                if (name := self.whole.get(tuple(words[i : i + n]))) is not None:
                    return name
            if w in NOISE or len(w) < 3:
                continue
            end = i + 1
            while end < len(words) and end - i < self.longest and self.extends(words[end]):
                end += 1
            return " ".join(words[i:end])
        return ""


def sound(name: str) -> str:
    for a, b in SOUNDS:
        name = name.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", name)


def grams(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Name and code of every pair of letters, side by side and with one between, with marks at the ends of words."""
    marked = [f"^{n.replace(' ', '$^')}$" for n in names]
    cp = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    name = np.repeat(np.arange(len(names)), [len(m) for m in marked])
    end = cp == ord("$")
    pair = np.flatnonzero(~end)
    skip = pair[~end[np.minimum(pair + 1, len(cp) - 1)]]
    side = cp[pair] << np.uint64(32) | cp[np.minimum(pair + 1, len(cp) - 1)] << np.uint64(1)
    far = cp[skip] << np.uint64(32) | cp[skip + 2] << np.uint64(1) | np.uint64(1)
    return np.concatenate((name[pair], name[skip])), np.concatenate((side, far))


def edits(a: str, b: str, most: int) -> int:
    """Changes, inserts, deletes and swaps of neighbours between two names; a number over `most` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # what both begin and end with costs nothing
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    end = 0
    while end < high - low and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low : len(a) - end], b[low : len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(before[j - 1] + (x != y), before[j] + 1, now[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before2[j - 2] + 1)
            now.append(best)
        if min(now) > most:
            return most + 1
        before2, before = before, now
    return before[-1]


def letter_counts(names: list[str]) -> np.ndarray:
    """How often each letter is in each name; letters of other scripts share a column."""
    out = np.zeros((len(names), 32), np.int16)
    if names:
        cp = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        np.add.at(out, (np.repeat(np.arange(len(names)), [len(n) for n in names]), cp & 31), 1)
    return out


def within(counts: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Whether as few slips are possible: each takes away one letter and adds one at most."""
    d = counts - own
    return (np.maximum(d, 0).sum(1) <= most) & (np.maximum(-d, 0).sum(1) <= most)


class Weights:
    """How rare each n-gram and letter is in the entries of the whole list."""

    def __init__(self):
        self.n, self.codes, self.counts, self.letters = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(32)

    def add(self, keys: list[str]) -> None:
        sounds = [sound(k) for k in keys]
        self.n += len(sounds)
        name, code = grams(sounds)
        once = np.unique(np.stack((name.astype(np.uint64), code)), axis=1)[1] if len(code) else code
        self.codes, back = np.unique(np.concatenate((self.codes, once)), return_inverse=True)
        self.counts = np.bincount(back, np.concatenate((self.counts, np.ones(len(once))))).astype(np.int64)
        self.letters += (letter_counts(sounds) > 0).sum(0)

    def of(self, code: np.ndarray) -> np.ndarray:
        """Weights of n-grams; those of no entry weigh like those of one."""
        if not len(self.codes):
            return np.zeros(len(code))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.log(1 + self.n / np.where(self.codes[at] == code, self.counts[at], 1))

    def of_letters(self) -> np.ndarray:
        return np.log(1 + self.n / np.maximum(1, self.letters))

    def bags(self, sounds: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Name, code and weight of each name's different n-grams, in order of name."""
        name, code = grams(sounds)
        order = np.lexsort((code, name))
        name, code = name[order], code[order]
        first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (code[1:] != code[:-1])))) if len(name) else np.zeros(0, np.int64)
        return name[first], code[first], np.diff(first, append=len(name)) * self.of(code[first])


#: Slips, cosine (negative, so that less is better), key and id of a candidate.
Hit = tuple[int, float, str, object]


class Index:
    """Inverted index of the n-grams of a block of entries."""

    def __init__(self, ids: list, keys: list[str], weights: Weights | None = None):
        least: dict[str, object] = {}
        for key, i in sorted({(normal(k), i) for i, k in zip(ids, keys) if normal(k)}):
            least.setdefault(key, i)  # equal keys go to the least id
        self.keys, self.ids, self.exact = list(least), list(least.values()), least
        if weights is None:
            weights = Weights()
            weights.add(self.keys)
        self.weights, self.letter_weights = weights, weights.of_letters()
        self.sounds = [sound(k) for k in self.keys]
        self.spaces = np.array([k.count(" ") for k in self.keys], np.int64)
        self.letters, self.sound_letters = letter_counts(self.keys), letter_counts(self.sounds)
        self.letter_part = self.sound_letters * self.letter_weights
        self.letter_norm = np.sqrt((self.letter_part**2).sum(1))
        entry, code, weight = weights.bags(self.sounds)
        self.norm = np.sqrt(np.maximum(np.bincount(entry, weight**2, len(self.keys)) + self.letter_norm**2, 1e-12))
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.at, self.entry, self.weight = np.append(first, len(code)), entry[order], weight[order]
        self.known: dict[str, tuple[list[Hit], float]] = {}

    def scores(self, names: list[str], least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Name, entry and cosine of every pair that shares an n-gram and reaches `least`, and the highest cosine of each name's pairs that may reach it; names as they sound."""
        size, top = len(self.keys), np.zeros(len(names))
        who, code, weight = self.weights.bags(names)
        own = letter_counts(names) * self.letter_weights
        length = np.sqrt(np.maximum(np.bincount(who, weight**2, len(names)) + (own**2).sum(1), 1e-12))
        slot = np.searchsorted(self.codes, code)
        there = np.flatnonzero(slot < len(self.codes))
        there = there[self.codes[slot[there]] == code[there]]
        if not len(there):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), top
        begin = self.at[slot[there]]
        many = self.at[slot[there] + 1] - begin
        places = np.arange(many.sum()) + np.repeat(begin - np.cumsum(many) + many, many)
        pair = np.repeat(who[there] * size, many) + self.entry[places]
        value = np.repeat(weight[there], many) * self.weight[places]
        if len(names) * size <= 16 * len(pair):
            dense = np.bincount(pair, value, len(names) * size)
            pair = np.flatnonzero(dense)
            value = dense[pair]
        else:  # the pairs that are touched only
            order = np.argsort(pair, kind="stable")
            pair, value = pair[order], value[order]
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            pair, value = pair[first], np.add.reduceat(value, first)
        name, entry = np.divmod(pair, size)
        whole = length[name] * self.norm[entry]
        # letters add no more than the product of both lengths
        near = value + np.sqrt((own**2).sum(1))[name] * self.letter_norm[entry] >= least * whole
        name, entry = name[near], entry[near]
        value = (value[near] + (own[name] * self.letter_part[entry]).sum(1)) / whole[near]
        np.maximum.at(top, name, value)
        near = value >= least
        return name[near], entry[near], value[near], top

    def find(self, names: list[str]) -> list[tuple[list[Hit], float]]:
        """Of each name the two best candidates within the slips, best first, and the highest cosine of all."""
        out: list[tuple[list[Hit], float]] = []
        step = max(1, CELLS // max(1, len(self.keys)))
        for at in range(0, len(names), step):
            out += self._find(names[at : at + step])
        return out

    def _find(self, names: list[str]) -> list[tuple[list[Hit], float]]:
        own = [sound(n) for n in names]
        name, entry, cosine, top = self.scores(own, THRESHOLD)
        spaces = np.array([n.count(" ") for n in names], np.int64)
        near = spaces[name] == self.spaces[entry]  # an extended name is an entry of its own
        name, entry, cosine = name[near], entry[near], cosine[near]
        near = within(self.letters[entry], letter_counts(names)[name], SLIPS) | within(self.sound_letters[entry], letter_counts(own)[name], SLIPS)
        name, entry, cosine = name[near], entry[near], cosine[near]
        order = np.lexsort((-cosine, name))
        hits: list[list[Hit]] = [[] for _ in names]
        fewest = [SLIPS] * len(names)
        for i, j, c in zip(name[order].tolist(), entry[order].tolist(), cosine[order].tolist()):
            most = fewest[i]  # a candidate with more slips than another is neither the best nor its rival
            slips = edits(names[i], self.keys[j], most)
            if slips:
                slips = min(slips, edits(own[i], self.sounds[j], min(slips, most)))
            if slips <= most:
                hits[i].append((slips, -round(c, 9), self.keys[j], self.ids[j]))
                fewest[i] = slips
        return [(sorted(h, key=lambda x: x[:3])[:2], float(t)) for h, t in zip(hits, top)]


def accepted(hits: list[Hit], top: float) -> tuple[object, float, float]:
    """Id of the accepted candidate (None if none), its cosine (the highest one if none), its lead over a runner-up of equal slips (1 without one)."""
    if not hits:
        return None, top, 0.0
    score = -hits[0][1]
    if len(hits) == 1 or hits[1][0] > hits[0][0]:
        return hits[0][3], score, 1.0
    lead = score + hits[1][1]
    return (hits[0][3] if lead >= MARGIN else None), score, lead


def _lookup(index: Index, names: list[str | None]) -> list[tuple[list[Hit], float]]:
    """Candidates of each name; a name equal to an entry has that one only. Each distinct name is scored once in a worker, as long as it is kept."""
    new, cache = [], index.known
    if len(cache) >= KEPT:
        cache.clear()
    for n in dict.fromkeys(names):
        if n is not None and n not in cache:
            if not n:
                cache[n] = [], 0.0
            elif n in index.exact:
                cache[n] = [(0, -1.0, n, index.exact[n])], 1.0
            else:
                new.append(n)
    cache.update(zip(new, index.find(new)))
    return [cache[n] if n is not None else ([], 0.0) for n in names]


def map_names(df: DataFrame, column: str, entries: DataFrame, entry_id: str = "name_id", entry_key: str = "name_key", prefix: str = "") -> DataFrame:
    """df's columns, then name_id (-1 if the list has no such entry), name_score (cosine) and name_lead.

    Strengths, forms, salts, frequency, bracketed names and marks of a value don't count, unless an entry has them as it
    stands. Null, empty and unreadable values get -1. Repeated rows are kept. Values are deduplicated within a worker, so
    no row is moved and frequent values cost nothing more. A list of more than BLOCK_ENTRIES entries is taken in blocks
    of that size; the result is that of one block. Entries with a null key or id are left out; equal keys go to the least
    id. Existing columns of the new names are a ValueError.
    """
    spark = df.sparkSession
    new = [prefix + x for x in ("name_id", "name_score", "name_lead")]
    no_clash(df, new)
    listed = entries.select(F.col(quoted(entry_id)).alias("id"), F.col(quoted(entry_key)).cast("string").alias("key")).where("id is not null and key is not null")
    kind = listed.schema["id"].dataType
    count = listed.count()
    parts = max(1, -(-count // BLOCK_ENTRIES))
    names = df.columns
    n, at = len(names), names.index(column)
    id_type, schema = arrow_type(kind), spec(df, f"{quoted(new[0])} {kind.simpleString()}, {quoted(new[1])} double, {quoted(new[2])} double")

    def block(part: int) -> tuple[list, list[str]]:
        found = (listed.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else listed).toArrow()
        return found.column(0).to_pylist(), found.column(1).to_pylist()

    weights, every = Weights(), []
    for part in range(parts):  # what the whole list says: bounded by its n-grams and words
        keys = [k for k in dict.fromkeys(map(normal, block(part)[1])) if k]
        weights.add(keys)
        every.append(Words(keys))
    words = every[0]
    for other in every[1:]:
        words.whole |= other.whole
        words.longest, words.later = max(words.longest, other.longest), words.later | other.later
    sent = [spark.sparkContext.broadcast((words, Index(*block(part), weights))) for part in range(parts)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            words = sent[0].value[0]
            leading = {t: words.leading(t) for t in dict.fromkeys(texts) if t is not None}
            typed = [None if t is None else leading[t] for t in texts]
            distinct = list(dict.fromkeys(typed))
            found: dict = {x: ([], 0.0) for x in distinct}
            for b in sent:
                for x, (hits, top) in zip(distinct, _lookup(b.value[1], distinct)):
                    found[x] = sorted([*found[x][0], *hits], key=lambda h: h[:3])[:2] if hits else found[x][0], max(found[x][1], top)
            settled = {}
            for x, (hits, top) in found.items():
                one = hits[:1] if hits and hits[0][:2] == (0, -1.0) else hits  # an equal entry has no rival
                settled[x] = accepted(one, top)
            rows = [settled[x] for x in typed]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([-1 if r[0] is None else r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], [*names, *new])

    return df.mapInArrow(find, schema)
