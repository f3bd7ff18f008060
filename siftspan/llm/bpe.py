"""Byte-pair encoding and decoding of whole texts by batched numpy merge rounds.

A text is cut at white space into chunks, which the split patterns of both supported kinds never cross. Chunks get
codes from a bounded dictionary; new chunks are split into words, and the words that are new are merged together: the
symbols of all of them lie in one flat array, and each round looks pairs up by binary search over the sorted pair
keys, takes the lowest rank in every word and merges. A pair is merged everywhere in a word at once only if no pair
that its result may start has a lower rank; otherwise only its leftmost place, as a queue of (rank, place) would.

Tokenizer files are JSON files of the tokenizers library with a BPE model over byte symbols; others are refused.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from siftspan.llm.common import text_slices, tidy

#: White space as Unicode has it (Python's own class also takes U+001C to U+001F).
WS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split patterns of the two kinds of tokenizer files.
SPLIT_LETTERS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+"
SPLIT_SPACED = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"

#: Ends in something that is surely not white space.
SOLID = r"[\p{L}\p{N}\p{P}\p{S}\p{M}]$"

#: Chunks and words whose ids are kept by a worker; past it the dictionaries start anew.
MAX_CODES = 600_000
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class _Codes(dict):
    """Codes of keys, given in order of first use; new keys are noted."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        code = self[key] = len(self)
        self.new.append(key)
        return code


class _Table:
    """Runs of ids by code, in one growing array."""

    def __init__(self):
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.codes = 0

    def append(self, flat: np.ndarray, counts: np.ndarray) -> None:
        for name, need in (("flat", self.used + len(flat)), ("start", self.codes + len(counts)), ("count", self.codes + len(counts))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have)), have.dtype)]))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.codes : self.codes + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.codes : self.codes + len(counts)] = counts
        self.used += len(flat)
        self.codes += len(counts)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all codes, end to end, and how many each has."""
        counts = self.count[codes]
        total = int(counts.sum())
        ends = np.cumsum(counts)
        places = np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(self.start[codes], counts)
        return self.flat[places], counts


def spaced_chunks(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks of one text or more, the number of each occurrence's chunk, and the chunks of each text.

    A text is cut before every space that follows something else than white space: there a match of SPLIT_SPACED
    begins, as none holds a space after another character.
    """
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    per = np.asarray(pc.list_value_length(split)).astype(np.int64)
    parts = split.flatten().dictionary_encode()
    names, code = parts.dictionary, np.asarray(parts.indices).astype(np.int64)
    ends = np.cumsum(per)
    begins = np.ones(len(code), bool)
    begins[1:] = np.asarray(pc.match_substring_regex(names, SOLID), bool)[code[:-1]]
    opens = np.zeros(len(code), bool)
    opens[ends - per] = True
    begins |= opens
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(code)))
    opens = opens[start]
    # Two numbers a part: in the middle of a text (a space before it) and at its beginning; then those of joined parts.
    chunk = 2 * code[start] + opens
    extra: dict[str, int] = {}
    long = np.flatnonzero(length > 1)
    if len(long):
        inside = names.take(pa.array(code[np.repeat(length > 1, length)])).cast(pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length[long])), pa.int32()), inside), " ").to_pylist()
        chunk[long] = [2 * len(names) + extra.setdefault(s if first else " " + s, len(extra)) for s, first in zip(joined, opens[long].tolist(), strict=True)]
    used = np.flatnonzero(np.bincount(chunk))
    single = used[used < 2 * len(names)]
    added = list(extra)
    before = pa.array(["", " "], pa.large_string()).take(pa.array(1 - single % 2))
    strings = pc.binary_join_element_wise(before, names.take(pa.array(single // 2)), pa.scalar("", pa.large_string())).to_numpy(zero_copy_only=False).tolist()
    strings += [added[i - 2 * len(names)] for i in used[len(single) :].tolist()]
    place = np.zeros(2 * len(names) + len(added), np.int64)
    place[used] = np.arange(len(used))
    sums = np.append(0, np.cumsum(begins))
    return strings, place[chunk], sums[ends] - sums[ends - per]


class Bpe:
    """An encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, max_codes: int | None = None):
        self.max_codes = max_codes or MAX_CODES
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = json.dumps(spec["pre_tokenizer"])
        if model.get("type", "BPE") != "BPE" or "ByteLevel" not in pre or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a byte-level BPE file of a supported kind")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = bool(spec["normalizer"])
        self.spaced_decode = spec["decoder"] is None
        vocab: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.decimals = [str(i) for i in range(size)]
        chars = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int32)
        self.last = np.array([vocab.get(c + self.suffix, -1) for c in chars], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        into = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.size = size
        order = np.argsort(left * size + right, kind="stable")
        self.keys, self.ranks, self.into = (left * size + right)[order], order.astype(np.int32), into[order]
        first = np.full(size, NONE, np.int64)  # the lowest rank of a pair that a symbol is part of
        np.minimum.at(first, left, np.arange(len(merges)))
        np.minimum.at(first, right, np.arange(len(merges)))
        self.everywhere = first[self.into] > self.ranks
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT_LETTERS if self.lower else SPLIT_SPACED).findall
        self.chunks = re.compile(rf"[^{WS}]+" if self.lower else rf"[{WS}]*[^{WS}]+|[{WS}]+").findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self.reset()

    def reset(self) -> None:
        self.chunk_codes, self.chunk_ids = _Codes(), _Table()
        self.word_codes, self.word_ids = _Codes(), _Table()

    # -- merging

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair (NONE: no merge) and its place among the sorted keys."""
        keys = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE).astype(np.int32), at.astype(np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and how many each has."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        full = sizes > 0
        symbols[ends[full] - 1] = self.last[data[ends[full] - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        known = symbols >= 0
        symbols, word = symbols[known], word[known]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NONE, np.int32)  # of the pair that starts here
        at = np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], at[:-1] = self.look_up(symbols[:-1], symbols[1:])
            rank[:-1][word[1:] != word[:-1]] = NONE
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            ready = np.repeat(lowest == NONE, lengths)
            if ready.any():
                done.append((word[ready], symbols[ready]))
                rest = ~ready
                symbols, word, rank, at = symbols[rest], word[rest], rank[rest], at[rest]
                if not len(symbols):
                    break
                open_ = lowest != NONE
                lowest, lengths = lowest[open_], lengths[open_]
                starts = np.cumsum(lengths) - lengths
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            # the first hit of each word, and where it may be merged everywhere, every other one of a run of touching hits
            new_word = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
            touching = np.concatenate([[False], hit[1:] == hit[:-1] + 1]) & ~new_word
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(touching, 0, np.arange(len(hit))))
            hit = hit[new_word | (self.everywhere[at[hit]] & (run % 2 == 0))]
            symbols[hit] = self.into[at[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # their places once the right halves are gone
            symbols, word, rank, at = symbols[keep], word[keep], rank[keep], at[keep]
            near = np.zeros(len(symbols) + 1, bool)
            near[moved] = True
            near[moved - 1] = True  # the spare last place takes what would be before the first
            touched = np.flatnonzero(near[:-1])
            rank[touched] = NONE
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], at[touched] = self.look_up(symbols[touched], symbols[touched + 1])
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int32)
        order = np.argsort(word, kind="stable")
        return flat[order], np.bincount(word, minlength=len(words))

    # -- texts

    def keys_of(self, text: str) -> list:
        """The chunks of a text; a special token is a tuple."""
        if self.specials and self.specials.search(text):
            out: list = []
            for i, part in enumerate(self.specials.split(text)):
                out += [(part,)] if i % 2 else self.plain(part)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not self.lower:
            return self.chunks(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return self.chunks(text) if self.odd(text) else text.split()

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each has."""
        if len(self.chunk_codes) > self.max_codes or len(self.word_codes) > self.max_codes:
            self.reset()
        look = self.chunk_codes.__getitem__
        if texts and not self.lower and not (self.specials and any(map(self.specials.search, texts))):
            keys, chunk, per = spaced_chunks(texts)
            codes = np.fromiter(map(look, keys), np.int64, len(keys))[chunk]
        else:
            parts = [self.keys_of(text) for text in texts]
            per = np.array([len(keys) for keys in parts], np.int64)
            codes = np.fromiter((look(key) for keys in parts for key in keys), np.int64, int(per.sum()))
        of_texts = per
        new, self.chunk_codes.new = self.chunk_codes.new, []
        if new:
            word = self.word_codes.__getitem__
            # Most chunks are one word, letters with a space before them at most.
            words = [[word(key)] if isinstance(key, tuple) or key.isascii() and key.removeprefix(" ").isalpha() else [word(w) for w in self.split(key)] for key in new]
            fresh, self.word_codes.new = self.word_codes.new, []
            flat, counts = self.merge(["" if isinstance(w, tuple) else w for w in fresh])
            tuples = [i for i, w in enumerate(fresh) if isinstance(w, tuple)]
            if tuples:
                before = np.cumsum(counts) - counts
                flat = np.insert(flat, before[tuples], [self.special[fresh[i][0]] for i in tuples])
                counts[tuples] = 1
            self.word_ids.append(flat, counts)
            per = np.array([len(w) for w in words], np.int64)
            flat, counts = self.word_ids.gather(np.array([c for w in words for c in w], np.int64))
            sums = np.concatenate([[0], np.cumsum(counts)])
            ends = np.cumsum(per)
            self.chunk_ids.append(flat, sums[ends] - sums[ends - per])
        flat, counts = self.chunk_ids.gather(codes)
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(of_texts)
        return flat, sums[ends] - sums[ends - of_texts]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included: token strings joined by spaces where the file names no decoder."""
        parts = map(self.tokens.__getitem__, ids)
        if self.spaced_decode:
            return " ".join(parts)
        out = bytearray()
        special = self.special
        for part in parts:
            out += part.encode("utf-8") if part in special else bytes(map(self.byte_of.__getitem__, part))
        return out.decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str, max_codes: int | None = None) -> Bpe:
    """The encoder of a file, kept by the worker process; `max_codes` bounds its dictionaries (about 200 bytes a code)."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    _LOADED[path].max_codes = max_codes or MAX_CODES
    return _LOADED[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row: the ids of the whole text and what they decode to.

    A null or empty text has no ids and decodes to an empty text. Rows are neither merged nor ordered; null ids stay
    null, and other columns of `docs` are not read. One narrow pass without a shuffle.
    """

    def run(batches):
        coder = load(path)
        for keys, texts in text_slices(batches):
            flat, counts = coder.encode_batch(texts)
            ends = np.cumsum(counts)
            runs = [flat[e - n : e] for e, n in zip(ends, counts, strict=True)]
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array([coder.decode(r.tolist()) for r in runs], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what `encode` gives, hashed where it is made.

    Null or empty texts: no tokens, and the digests of an empty string.
    """

    def run(batches):
        coder = load(path)
        for keys, texts in text_slices(batches):
            flat, counts = coder.encode_batch(texts)
            ends = np.cumsum(counts)
            a, b = [], []
            for e, n in zip(ends, counts, strict=True):
                ids = flat[e - n : e].tolist()
                a.append(sha256(" ".join(map(coder.decimals.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(coder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
