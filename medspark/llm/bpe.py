"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens: a path spells a word exactly as the merges do.  It
starts with one state and a loop for every symbol; each merge ``a b -> c``, in
order, adds its gadget: wherever an arc ``a`` leads on by ``b``, an arc ``c``
goes there directly, and the state entered by ``a`` loses its arc ``b``.  The
state entered by ``c`` starts as a copy of the one entered by ``b``.  All arcs
with one label enter one state, so a state is named by its label, and a gadget
stores only what it changes: the copy, the removed arc, the arc it follows.
``step`` follows these entries; results are tabled.

A word's path is found left to right: for every prefix exactly one label can
end its path.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from medspark.llm.texts import Recent, map_texts

WORD_ENTRIES, CHUNK_ENTRIES, ARC_ENTRIES = 60_000, 150_000, 120_000  # that one Python worker keeps, twice at most; others are computed again
#: lines of Latin letters that the normalizer lowers one by one, then signs that it keeps
_PLAIN = re.compile(r"^([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)$", re.MULTILINE)
_SHORT = (2, 1)
_NEVER = 1 << 60


class TokenizationAutomaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end = end
        self.label = {i: token for token, i in vocabulary.items()}
        size = max(self.label) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.removed: dict[tuple[int, int], int] = {}
        self._table: dict[int, bool] = {}  # by state and label
        made = set()
        for rank, (a, b) in enumerate(merges):
            i, j, c = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.step(i, j, rank):  # else no path has the pair: the gadget changes nothing
                self.removed[i, j] = rank
                if c not in made:
                    made.add(c)
                    self.rank[c], self.left[c], self.right[c] = rank, i, j
        merged = {a + b for a, b in merges}
        reached = {token: i for token, i in vocabulary.items() if i in made or token not in merged}
        self.inner = {t: i for t, i in reached.items() if not t.endswith(end) or t == end}
        self.final = {t[:-len(end)]: i for t, i in reached.items() if t.endswith(end) and t != end}
        #: the lengths of labels that begin with given three characters, longest first
        lengths: dict[str, set[int]] = {}
        for token in [*self.inner, *self.final]:
            if len(token) > 2:
                lengths.setdefault(token[:3], {*_SHORT}).add(len(token))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}

    def step(self, state: int, label: int, until: int = _NEVER) -> bool:
        """Is there an arc ``label`` from ``state``, counting gadgets before ``until``?"""
        while True:
            if self.removed.get((state, label), _NEVER) < until:
                return False
            formed, added = self.rank[state], self.rank[label]
            if formed > added:  # the state was copied when its gadget came
                until, state = formed, self.right[state]
            elif added >= 0:  # the arc was added beside that of its left part
                until, label = added + 1, self.left[label]
            else:
                return True

    def _arc(self, state: int, label: int) -> bool:
        if len(self._table) > ARC_ENTRIES:
            self._table.clear()
        known = self._table[state << 32 | label] = self.step(state, label)
        return known

    def encode(self, word: str) -> list[int]:
        """The labels of the path that spells ``word``: longest arcs first; a
        place from which no arc leads on is left and never entered again, since
        one path alone leads to each place."""
        n, lengths, inner, final, arcs = len(word), self.lengths, self.inner.get, self.final.get, self._table.get
        path, starts, dead, i = [], [], set(), 0
        sizes = lengths.get(word[:3], _SHORT)
        while i < n:
            for size in sizes:
                j = i + size
                if j > n or j in dead:
                    continue
                token = inner(word[i:j]) if j < n else final(word[i:])
                if token is None:
                    continue
                if path:
                    known = arcs(path[-1] << 32 | token)
                    if not (self._arc(path[-1], token) if known is None else known):
                        continue
                path.append(token)
                starts.append(i)
                i, sizes = j, lengths.get(word[j:j + 3], _SHORT)
                break
            else:
                dead.add(i)
                path.pop()
                i = starts.pop()
                sizes = lengths.get(word[i:i + 3], _SHORT)  # the place that was left is dead, longer ones are, too
        return path

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.label[i] for i in ids)


class WordEncoder:
    """Texts to ids by the automaton: special strings, the normalizer and the
    pre-splitter of the vocabulary file, then each word's path."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = TokenizationAutomaton(model["vocab"], pairs, model["end_of_word_suffix"] or "")
        self.automaton.label.update({i: t for t, i in self.special.items()})
        self._label = {i: t.encode() + b" " for i, t in self.automaton.label.items()}
        self._decimal = {i: b"%d " % i for i in self._label}
        tokenizer = Tokenizer.from_file(path)
        self._normal, self._split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        #: how the pre-splitter writes a letter's bytes
        self._letters = {c: self._split(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        names = sorted(self.special, key=len, reverse=True)
        self._cut = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self._words = Recent(lambda word: tuple(self.automaton.encode(word)), WORD_ENTRIES)
        self._known, self._older = {}, {}  # chunks used lately; twice CHUNK_ENTRIES and a slice's at most

    def _pieces(self, chunk: str):
        """Parts of a chunk between special strings, each with the id that follows it."""
        at = 0
        for m in self._cut.finditer(chunk):
            yield chunk[at:m.start()], self.special[m.group()]
            at = m.end()
        yield chunk[at:], None

    def ids_of(self, chunk: str) -> list[int]:
        ids = []
        for piece, special in self._pieces(chunk):
            for word, _ in self._split(self._normal(piece)) if piece else ():
                ids += self._words[word]
            if special is not None:
                ids.append(special)
        return ids

    def _entry(self, ids) -> tuple[int, bytes, bytes]:
        """(number of ids, ids, decoded), each id and label with a blank after it."""
        return len(ids), b"".join([self._decimal[i] for i in ids]), b"".join([self._label[i] for i in ids])

    def _learn(self, chunks: list[str]) -> None:
        """Makes the entries of ``chunks`` known: of letters and signs, two words at most
        for each, all at once; of others one by one."""
        if len(self._known) > CHUNK_ENTRIES:
            self._known, self._older = {}, self._known
        known, older = self._known, self._older
        new = []
        for chunk in set(chunks).difference(known):
            entry = older.get(chunk)
            if entry is None:
                new.append(chunk)
            else:
                known[chunk] = entry
        lines = "\n".join(new)
        plain = _PLAIN.findall(lines)
        words = "\n".join([letters for letters, _ in plain]).lower().translate(self._letters).split("\n")
        word, entry = self._words, self._entry
        for (letters, signs), spelled in zip(plain, words, strict=False):
            known[letters + signs] = entry(word[spelled] + word[signs] if signs else word[spelled])
        for chunk in new:
            if chunk not in known:
                known[chunk] = entry(self.ids_of(chunk))

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, list[tuple[int, bytes, bytes]]]:
        """Of the runs without ASCII white space of all texts (UTF-8): where each text's
        begin, their numbers, and what each number stands for: (number of ids, ids,
        decoded).  Neither words nor special strings reach across white space; runs
        without ids are left out."""
        runs = pa.compute.ascii_split_whitespace(texts)
        offsets, runs = runs.offsets.to_numpy(), runs.flatten().dictionary_encode()
        distinct = runs.dictionary.to_pylist()
        self._learn(distinct)
        entries, numbers = [*map(self._known.__getitem__, distinct)], runs.indices.to_numpy()
        empty = np.fromiter((not e[0] for e in entries), bool, len(entries))
        if empty.any():
            kept = ~empty[numbers]
            offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
            numbers = numbers[kept]
        return offsets, pa.array(numbers), entries


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker: workers serve many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _joined(offsets: np.ndarray, numbers: pa.Array, parts: list[bytes]) -> Iterator[memoryview]:
    """Each text's parts, one after another without the last blank."""
    taken = pa.array(parts, pa.large_binary()).take(numbers)
    _, ends, data = taken.buffers()
    places, data = np.frombuffer(ends, np.int64)[offsets].tolist(), memoryview(data or b"")
    for a, b in zip(places, places[1:], strict=False):
        yield data[a:max(a, b - 1)]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: number of ids, digest of the ids (decimal, joined
    by one space) and of the decoded text.  NULL and empty texts have no ids and
    decode to the empty text; repeated rows and NULL ids each keep their row."""
    def make():
        words = encoder(path)

        def columns(texts):
            offsets, numbers, entries = words.chunks(pa.array(texts, pa.binary()).cast(pa.string()))
            sizes = np.fromiter((e[0] for e in entries), np.int64, len(entries))[numbers.to_numpy()]
            counts = np.diff(np.concatenate(([0], np.cumsum(sizes)))[offsets])
            digests = ([hashlib.sha256(x).hexdigest() for x in _joined(offsets, numbers, [e[k] for e in entries])]
                       for k in (1, 2))
            return [pa.array(counts, pa.int64()), *(pa.array(d, pa.string()) for d in digests)]
        return columns

    return map_texts(df, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``ids`` as a list and the ``decoded`` text."""
    def make():
        words = encoder(path)

        def columns(texts):
            offsets, numbers, entries = words.chunks(pa.array(texts, pa.binary()).cast(pa.string()))
            ids, decoded = (_joined(offsets, numbers, [e[k] for e in entries]) for k in (1, 2))
            return [pa.array([[int(i) for i in bytes(row).split()] for row in ids], pa.list_(pa.int32())),
                    pa.array([bytes(row).decode() for row in decoded], pa.string())]
        return columns

    return map_texts(df, make, "ids array<int>, decoded string", id_col, text_col)
