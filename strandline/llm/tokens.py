"""Encoding by a byte-level BPE vocabulary through an automaton over token arcs.

The automaton's states are the tokens last read (and a start); an arc labelled u leaves state q if u may follow q
in the encoding of some word. It is compiled by adding one gadget per merge, in rank order: the gadget of (a, b) -> c
adds state and arc c, and takes away arc b behind every state in which a stands open at its right end until c is
made. For each token the gadgets leave two short tables, the parts open at its right and at its left end with the
rank that closes them; an arc (q, u) is barred if a merge of a part of q and a part of u comes before both are closed.
These tables are the compiled automaton in factored form, complete before the first text is read; written out, its
transition table would have 2.5e9 entries. Arcs that occur are kept written out, up to :data:`KEPT_ARCS` of them.

Texts are split into words by Spark. In the tasks the words of a batch are told apart by Arrow, each is encoded once,
and the ids of the texts are put together from those of their words by NumPy. The encoding of a word is the only path of open arcs that spells it, so a word is read from left to right, keeping
for each prefix the state it ends in; the path's labels are the ids. Decoding emits the bytes of the labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that splits text into words before the merges of this vocabulary.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids of texts that are null, empty or otherwise without a word.
NO_IDS: list[int] = []
OPEN = 1 << 60
#: Encoded words kept per worker; beyond that they are encoded anew.
KEPT_WORDS = 400_000
#: Arcs kept written out per worker (some 100 MB); beyond that they are resolved anew.
KEPT_ARCS = 1 << 20
#: Texts whose words are handled together.
TEXTS = 1000


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The automaton of one vocabulary file (the text of its JSON)."""

    def __init__(self, text: str) -> None:
        model = json.loads(text)["model"]
        letters, vocabulary = _byte_letters(), model["vocab"]
        self.spelling: dict[int, bytes] = {i: bytes(letters[x] for x in t) for t, i in vocabulary.items() if all(x in letters for x in t)}
        self.right_end: dict[int, list[tuple[int, int]]] = {}
        self.left_end: dict[int, list[tuple[int, int]]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for i, s in self.spelling.items():
            if len(s) == 1:
                self.right_end[i] = self.left_end[i] = [(i, OPEN)]
        for rank, merge in enumerate(model["merges"]):
            a, b = (vocabulary[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self._add_gadget(rank, a, b, vocabulary["".join(merge.split(" ") if isinstance(merge, str) else merge)])
        self.reachable: dict[int, bool] = {}
        self.table: dict[int, bool] = {}
        self.arcs = self._arcs_by_last_byte()
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(WORDS).findall

    def _add_gadget(self, rank: int, a: int, b: int, c: int) -> None:
        self.rank[a, b] = rank
        self.parts[c] = (a, b, rank)
        close = lambda end: [(t, rank if until == OPEN else until) for t, until in end]
        self.right_end[c] = [*close(self.right_end[b]), (c, OPEN)]
        self.left_end[c] = [*close(self.left_end[a]), (c, OPEN)]

    def _arcs_by_last_byte(self) -> list[dict[int, int]]:
        """The arcs' spellings, read backwards: nodes of a tree; -1 holds the arc that ends there."""
        tree: list[dict[int, int]] = [{}]
        for i, s in self.spelling.items():
            if i not in self.right_end:
                continue
            node = 0
            for byte in reversed(s):
                following = tree[node].get(byte)
                if following is None:
                    following = len(tree)
                    tree[node][byte] = following
                    tree.append({})
                node = following
            tree[node][-1] = i
        return tree

    def _crossed(self, q: int, u: int, before: int) -> bool:
        """Whether some merge across the border of q and u comes before its parts are closed, and before a rank.

        Of equal merges the left one comes first: a part of q closed by the same merge is gone, one of u is not.
        """
        rank = self.rank
        for x, x_until in self.right_end[q]:
            for y, y_until in self.left_end[u]:
                r = rank.get((x, y))
                if r is not None and r < before and r < x_until and r <= y_until:
                    return True
        return False

    def reached(self, t: int) -> bool:
        """Whether the merges ever make this token of its own bytes."""
        known = self.reachable.get(t)
        if known is None:
            made = self.parts.get(t)
            known = made is None or (self.reached(made[0]) and self.reached(made[1]) and not self._crossed(made[0], made[1], made[2]))
            self.reachable[t] = known
        return known

    def arc(self, q: int, u: int) -> bool:
        """Whether arc u leaves state q."""
        key = q << 32 | u
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= KEPT_ARCS:
                self.table.clear()
            known = self.table[key] = not self._crossed(q, u, OPEN)
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The labels of the one path that spells the word."""
        data = word.encode()
        tree = self.arcs
        states: list[int] = [-1]
        for end in range(1, len(data) + 1):
            node, at, state = tree[0], end, None
            while at > 0:
                following = node.get(data[at - 1])
                if following is None:
                    break
                node, at = tree[following], at - 1
                u = node.get(-1)
                if u is not None and self.reached(u) and (at == 0 or self.arc(states[at], u)):
                    state = u
                    break
            if state is None:
                raise ValueError("a byte has no arc")
            states.append(state)
        ids, at = [], len(data)
        while at > 0:
            ids.append(states[at])
            at -= len(self.spelling[states[at]])
        return tuple(reversed(ids))

    def known_word(self, word: str) -> tuple[int, ...]:
        """The ids of a word, from the kept ones if it is there."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.encode_word(word)
            if len(word) < 64:
                if len(self.words) >= KEPT_WORDS:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; :data:`NO_IDS` if it is null or empty."""
        return [i for word in self.split(text) for i in self.known_word(word)] if text else list(NO_IDS)

    def encode_words(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as their words: the ends of the texts, from 0 on, and the ids of all in turn."""
        distinct = words.flatten().dictionary_encode()
        coded = [self.known_word(w) for w in distinct.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter((i for c in coded for i in c), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        index = distinct.indices.to_numpy(zero_copy_only=False)
        counts = sizes[index] if len(index) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(starts[index] - before[:-1], counts) + np.arange(before[-1])] if len(index) else flat[:0]
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return before[np.concatenate([[0], np.cumsum(lengths)])], ids

    def decode(self, ids: list[int] | None) -> str:
        return b"".join(self.spelling[i] for i in ids or ()).decode("utf-8", "replace")


_compiled: dict[int, Automaton] = {}


def compiled(text: str) -> Automaton:
    """The automaton of a vocabulary, compiled once per Python process."""
    key = hash(text)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Automaton(text)
    return _compiled[key]


def _vocabulary(frame: DataFrame, path: str):
    """The file as a broadcast; it is the vocabulary, of a fixed size of about 1.5 MB."""
    with open(path, encoding="utf-8") as file:
        return frame.sparkSession.sparkContext.broadcast(file.read())


def _words(text: Column) -> tuple[Column, Column]:
    """The words of a text, split by Spark; and the text itself where it holds characters that Java's tables lack, whose words are then null."""
    strange = text.rlike(r"\p{Cn}")
    return F.when(~strange, F.regexp_extract_all(text, F.lit(f"(?U){WORDS}"), F.lit(0))), F.when(strange, text)


def _coded(automaton: Automaton, words: pa.ListArray, strange: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and ids of the texts of a batch; strange texts are split here."""
    if strange.null_count < len(strange):
        split = [automaton.split(t) if t is not None else w for w, t in zip(words.to_pylist(), strange.to_pylist())]
        words = pa.array(split, pa.list_(pa.string()))
    return automaton.encode_words(words)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` of every text. Null and empty texts have no ids (an empty list); texts may have any length."""
    shared = _vocabulary(documents, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                ends, ids = _coded(automaton, batch.column("_words"), batch.column("_strange"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    words, strange = _words(F.col("_text"))
    split = spread(documents.select(key, F.col(text).alias("_text"))).select(key, words.alias("_words"), strange.alias("_strange"))
    return split.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """The frame without its text, with the number of tokens of the text."""
    shared = _vocabulary(documents, vocabulary)
    kept = [c for c in documents.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(start, TEXTS)
                ends, _ = _coded(automaton, batch.column("_words"), batch.column("_strange"))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.diff(ends), pa.int64())], names=[*kept, into])

    schema = ", ".join([*[f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept], f"`{into}` bigint"])
    words, strange = _words(F.col(text))
    return spread(documents.select(*kept, text)).select(*kept, words.alias("_words"), strange.alias("_strange")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """``key, text`` of ids."""
    shared = _vocabulary(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([automaton.decode(i) for i in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
