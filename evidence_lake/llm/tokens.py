"""Token ids of whole texts by the tokenizers library, vectorised over Arrow batches.

A text of a word-level tokenizer (white space separates and is dropped) is the sequence of its
white-space words, so a batch is split and dictionary-encoded by Arrow, its distinct words are split
by the tokenizer file's own pattern, and the library is asked once for each new piece: many new
pieces go through it as one text, and the model's end-of-word marks tell them apart. Words with rare
characters, and other tokenizers' whole texts, go through the library's encode.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Split pieces kept in a worker's cache; beyond it only those of the batch at hand stay (results don't change).
CACHE_PIECES = 600_000
END_ID = 1
#: Words of other characters than these below U+0250 that print go through the library whole; there lower case and NFC are plain.
_RARE = r"[^!-~\x{A1}-\x{24F}]"
#: Words of letters alone are one piece; U+0130 has a lower case of two characters.
_LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _lower_joined(words: pa.Array) -> str:
    """The words in lower case, a line each."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return pc.binary_join(whole, "\n")[0].as_py().lower()


class TextEncoder:
    """Ids of texts under the tokenizer file at `path`, as one flat array with lengths."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.pattern = self._word_pattern(spec)
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.ends = np.array([bool(suffix) and (self.tok.id_to_token(i) or "").endswith(suffix) for i in range(self.tok.get_vocab_size())])
        # the cache: piece -> number; the ids of piece i are flat[first[i] : first[i + 1]]. The line break is piece 0, without ids
        self.pieces = {"\n": 0}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _keep(self, pieces: list[str]) -> None:
        """Forgets all but these known pieces."""
        numbers = self._numbers(pieces)
        size = np.diff(self.first)[numbers]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.first[numbers] - ends + size, size) + np.arange(size.sum())]
        self.first = np.concatenate(([0, 0], ends))
        self.pieces = {"\n": 0} | dict(zip(pieces, range(1, len(pieces) + 1)))

    @staticmethod
    def _word_pattern(spec: dict):
        """The split pattern of a tokenizer for which white space only separates; None for others."""
        norm = spec.get("normalizer") or {}
        steps = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
        pre = spec.get("pre_tokenizer") or {}
        first, *rest = pre.get("pretokenizers") or [pre]
        removes = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        plain = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and not re.search(r"\s", a["content"]) for a in spec.get("added_tokens", []))
        split = first.get("pattern", {}).get("Regex", "")
        if steps == ["NFC", "Replace", "Lowercase"] and removes and plain and added and r"[^\s\p{L}\p{N}]+" in split and regex.findall(split, "a\u00e0\u024fz") == ["a\u00e0\u024fz"]:
            return regex.compile(r"\n|" + split)
        return None

    @property
    def word_level(self) -> bool:
        return self.pattern is not None

    def _learn(self, pieces: list[str]) -> None:
        """Takes new split pieces into the cache."""
        plain = [p for p in pieces if p.isalpha()]
        ids = np.array(self.tok.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(plain) or len(ids) and ends[-1] != len(ids) - 1:  # no such marks
            plain, ids, ends = [], ids[:0], ends[:0]
        done, level, model = set(plain), self.tok.pre_tokenizer, self.tok.model
        other = [p for p in pieces if p not in done]
        # printable ASCII stands for itself at byte level
        split = [[t.id for x in ([p] if p.isascii() and p.isprintable() else [x for x, _ in level.pre_tokenize_str(p)]) for t in model.tokenize(x)] for p in other]
        size = np.concatenate([np.diff(ends, prepend=-1), np.fromiter(map(len, split), np.int64, len(split))])
        self.pieces.update(zip(plain + other, range(len(self.pieces), len(self.pieces) + len(size))))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.flat = np.concatenate([self.flat, ids, np.array([i for x in split for i in x], np.uint32)])

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Cache numbers of known pieces, -1 of others."""
        return np.fromiter(map(self.pieces.get, pieces, repeat(-1)), np.int64, len(pieces))

    def _vocabulary(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a flat array of ids, where the ids of each word begin in it, how many they are)."""
        rare = pc.match_substring_regex(vocab, _RARE)
        for a in self.added:
            rare = pc.or_(rare, pc.match_substring(vocab, a))
        whole = pc.and_not(pc.match_substring_regex(vocab, _LETTERS), rare)
        mixed = pc.invert(pc.or_(rare, whole))
        at_rare, at_whole, at_mixed = (np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in (rare, whole, mixed))
        words = _lower_joined(vocab.filter(whole)).split("\n") if len(at_whole) else []
        split = self.pattern.findall(_lower_joined(vocab.filter(mixed)) + "\n") if len(at_mixed) else []
        of_words, of_split = self._numbers(words), self._numbers(split)
        sides = [(words, of_words, np.flatnonzero(of_words < 0)), (split, of_split, np.flatnonzero(of_split < 0))]
        missing = [[all_[i] for i in at.tolist()] for all_, _, at in sides]
        if new := set(missing[0]).union(missing[1]):
            if len(self.pieces) + len(new) > CACHE_PIECES:
                self._keep(list({*words, *split, "\n"}.difference(new, "\n")))
                sides = [(all_, numbers, slice(None)) for all_, numbers, _ in sides]
                missing = [words, split]
            self._learn(list(new))
            for (_, numbers, at), wanted in zip(sides, missing):
                numbers[at] = self._numbers(wanted)
        begin, many = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
        size = np.diff(self.first)
        begin[at_whole], many[at_whole] = self.first[of_words], size[of_words]
        # words of several pieces lie behind the cache's ids
        per = size[of_split]
        bound = np.cumsum(per)
        got = self.flat[np.repeat(self.first[of_split] - bound + per, per) + np.arange(bound[-1] if len(bound) else 0)]
        ends = bound[of_split == 0]
        many[at_mixed] = np.diff(ends, prepend=0)
        begin[at_mixed] = len(self.flat) + ends - many[at_mixed]
        known = [self.tok.encode(w, add_special_tokens=False).ids for w in vocab.take(pa.array(at_rare)).to_pylist()]
        many[at_rare] = np.fromiter(map(len, known), np.int64, len(known))
        begin[at_rare] = len(self.flat) + len(got) + np.cumsum(many[at_rare]) - many[at_rare]
        return np.concatenate([self.flat, got, np.array([i for x in known for i in x], np.uint32)]), begin, many

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.ascii_split_whitespace(texts)
        per_text = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(parts).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(per_text), np.int64)
        flat, first, size = self._vocabulary(coded.dictionary)
        many = size[code]
        bound = np.zeros(len(code) + 1, np.int64)
        np.cumsum(many, out=bound[1:])
        kind = np.int32 if max(bound[-1], len(flat)) < 2**31 else np.int64
        at = np.arange(bound[-1], dtype=kind)
        at += np.repeat((first[code] - bound[:-1]).astype(kind), many)
        edge = np.zeros(len(per_text) + 1, np.int64)
        np.cumsum(per_text, out=edge[1:])
        return flat[at], np.diff(bound[edge])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, as uint32; number of ids of each text). Null: no id."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.word_level and len(texts):
            return self._by_words(texts)
        ids = [e.ids for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return (np.concatenate([np.array(x, np.uint32) for x in ids]) if ids else np.zeros(0, np.uint32)), size


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about most_bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size) // most_bytes
    cut = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(size)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def with_end(ids: np.ndarray, size: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each text."""
    ends = np.cumsum(size + 1)
    out = np.empty(len(ids) + len(size), np.uint32)
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    out[mask] = ids
    out[ends - 1] = end
    return out, size + 1


LOADED: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker and file."""
    if path not in LOADED:
        LOADED[path] = TextEncoder(path)
    return LOADED[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For each run of rows: the rows, their ids with end ids, their lengths."""
    enc = encoder(path)
    for batch in batches:
        for part in slices(batch, text):
            yield part, *with_end(*enc.encode(part.column(text)))
