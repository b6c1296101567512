"""Token ids in binary files, compressed by Re-Pair.

Documents are put in order of doc_id (a range partition each task, sorted inside) and encoded with a public tokenizer.
Each task writes shards of a bounded number of ids. In a shard, frequent pairs of ids inside documents are replaced by
nonterminals, round after round (in a round many pairs at once, overlapping ones from the left), until no pair is
frequent. A shard holds the rules with the lengths of their expansions, and for each document where its symbols begin,
so that any document, and any id in it, is decoded without the rest.

Shard payload, little-endian: magic ``HXTK1``; counts as u64 (documents, rules, symbols, ids, terminals); doc_ids i64
and a null flag u8 each; first symbol of each document u64 (documents + 1); rules as u32 pairs; expansion lengths u32;
block offsets u64; blocks of 65,536 symbols u32, each compressed by zstd. Payloads are rows of a Parquet table in the
shared folder, so that they lie in whatever store the cluster uses.

Defined results: a null or empty text has the end id alone; a null doc_id comes first; repeated ids are in order of a
hash of their texts; a text of any length is encoded whole and may make a shard larger than the bound; an empty table
gives an empty file set and no rows. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, kept, lean, ragged, released, shared_dir, slices, table, text_bytes, word_hashes

END_ID = 0
#: Ids in a shard; a task holds one shard at a time.
SHARD_IDS = 1_500_000
BLOCK = 65_536
#: Re-Pair: new symbols in a round at most, least count of a pair.
RULES = 4096
LEAST = 24
#: Pieces that a worker remembers with their ids (about 50 bytes each), and letters of such a piece at most.
REMEMBERED = 600_000
LONGEST = 64
RANGE_BYTES = 16 << 20

_MAGIC = b"HXTK1\0\0\0"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies; a line break stands between words here."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(rest)} | {10: "\n"}


class Encoder:
    """Ids of whole texts, by pieces.

    Texts are cut before every single space or line break between two characters that are not white space. The tokenizer
    never joins over such a place, so a piece gives the same ids alone as in its text. Texts with other white space at a cut
    are encoded whole. Pieces are remembered by two 64-bit hashes in sorted arrays, so that no string is made of a known
    one. Of the others, a piece of letters with marks behind (no apostrophe) is two words to the tokenizer, the letters with
    their space and the marks, and a line break is one of its own; words go to its model at once.
    """

    MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.hash, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.slot, self.hits = np.empty(0, np.int64), np.empty(0, np.uint8)
        self.ids = np.empty(1 << 20, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)  # slot k holds ids at[k] to at[k + 1]
        self.n = 0
        self.fixed()

    def fixed(self) -> None:
        """Slots that are always there."""
        self.marks: dict[str, int] = {"": int(self.listed([[]])[0])}  # slots of marks
        self.gap = int(self.listed([[t.id for t in self.word(chr(256 + 10))]])[0])

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Slots, -1 for pieces that are not known."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hash, hashes[order]), len(self.hash) - 1)
        good = (self.hash[at] == hashes) & (self.check[at] == checks)
        self.hits[at[good]] = 1
        return np.where(good, self.slot[at], -1)

    def keep(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New slots for these ids."""
        n = self.n
        while n + len(counts) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        ends = self.at[n] + np.cumsum(counts)
        while self.at[n] + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.at[n] : self.at[n] + len(ids)] = ids
        self.at[n + 1 : n + 1 + len(counts)] = ends
        self.n += len(counts)
        return np.arange(n, self.n)

    def listed(self, ids: list[list[int]]) -> np.ndarray:
        return self.keep(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def remember(self, hashes: np.ndarray, checks: np.ndarray, slots: np.ndarray) -> None:
        every = np.concatenate([self.hash, hashes])
        order = np.argsort(every, kind="stable")
        self.hash, self.check = every[order], np.concatenate([self.check, checks])[order]
        self.slot, self.hits = np.concatenate([self.slot, slots])[order], np.concatenate([self.hits, np.zeros(len(slots), np.uint8)])[order]

    def tidy(self) -> None:
        """Between batches: nothing but remembered pieces stays; of too many, those that came back since the last time."""
        if self.n <= REMEMBERED:
            return
        good = self.hits > 0 if 2 * int(self.hits.sum()) <= REMEMBERED else np.zeros(len(self.hits), bool)
        self.hash, self.check, slot = self.hash[good], self.check[good], self.slot[good]
        size = self.at[slot + 1] - self.at[slot]
        ids = self.ids[ragged(self.at[slot], size)]
        self.n, self.slot, self.hits = len(slot), np.arange(len(slot)), np.zeros(len(slot), np.uint8)
        self.at = np.zeros(max(1 << 16, 2 * len(slot)), np.int64)
        self.at[1 : len(slot) + 1] = np.cumsum(size)
        self.ids = np.concatenate([ids, np.empty(1 << 20, np.uint32)])
        self.fixed()

    def words(self, words: list[str]) -> np.ndarray:
        """New slots for letters with their space, if any, or for marks; each is one word to the tokenizer."""
        tokenize, letters = self.word, "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n")
        ids, counts = [], []
        for w in letters:
            found = tokenize(w)
            ids += [t.id for t in found]
            counts.append(len(found))
        return self.keep(np.array(ids, np.uint32), np.array(counts, np.int64))

    def new(self, pieces: pa.Array, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Slots of pieces that are not known yet."""
        lead = pc.utf8_slice_codeunits(pieces, 0, 1)
        broken, led = pc.equal(lead, "\n"), pc.is_in(lead, pa.array([" ", "\n"], pa.large_string()))
        body = pc.if_else(led, pc.utf8_slice_codeunits(pieces, 1), pieces)
        stems = pc.utf8_rtrim(body, self.MARKS)
        alpha = pc.utf8_is_alpha(stems)
        whole = pc.and_not(pc.and_(alpha, pc.equal(stems, body)), broken).to_numpy(zero_copy_only=False)
        plain, broken = alpha.to_numpy(zero_copy_only=False), broken.to_numpy(zero_copy_only=False)
        length = pc.utf8_length(pieces).to_numpy()
        out = np.full(len(pieces), -1)

        if len(at := np.flatnonzero(whole)):
            out[at] = self.words(pieces.take(pa.array(at)).to_pylist())
            at = at[length[at] <= LONGEST]
            self.remember(hashes[at], checks[at], out[at])
        later = np.flatnonzero(~whole & (length <= LONGEST))  # remembered at the end, with stems
        hashes, checks, stem_slots = [hashes[later]], [checks[later]], []
        if len(at := np.flatnonzero(plain & ~whole)):
            take = pa.array(at)
            gap = pc.if_else(pc.and_not(led, pa.array(broken)), " ", "").cast(pa.large_string()).take(take)
            stem = pc.binary_join_element_wise(gap, stems.take(take), pa.scalar("", pa.large_string()))
            key, check = self.keys(stem)
            known = self.find(key, check)
            if len(gone := np.flatnonzero(known < 0)):
                _, first, same = np.unique(key[gone], return_index=True, return_inverse=True)
                first = gone[first]
                slots = self.words(stem.take(pa.array(first)).to_pylist())
                known[gone] = np.where(check[gone] == check[first][same], slots[same], -1)
                for j in np.flatnonzero(known < 0).tolist():  # hashes that collide
                    known[j] = self.words([stem[j].as_py()])[0]
                brief = pc.utf8_length(stem).to_numpy()[first] <= LONGEST
                hashes.append(key[first[brief]])
                checks.append(check[first[brief]])
                stem_slots.append(slots[brief])
            # the marks are the last bytes of each piece
            raw, ends = text_bytes(body.take(take))
            size = pc.binary_length(body).to_numpy()[at] - pc.binary_length(stems).to_numpy()[at]
            coded = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(raw[ragged(ends[1:] - size, size)])).dictionary_encode()
            for tail in [t for t in coded.dictionary.to_pylist() if t not in self.marks]:
                self.marks[tail] = int(self.words([tail])[0])
            tails = np.array([self.marks[t] for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            parts = np.stack([np.where(broken[at], self.gap, self.marks[""]), known, tails], axis=1)
            size = self.at[parts + 1] - self.at[parts]
            out[at] = self.keep(self.ids[ragged(self.at[parts].reshape(-1), size.reshape(-1))], size.sum(axis=1))
        if len(at := np.flatnonzero(~plain)):
            out[at] = self.listed([e.ids for e in self.tokenizer.encode_batch_fast(pieces.take(pa.array(at)).to_pylist(), add_special_tokens=False)])
        self.remember(np.concatenate(hashes), np.concatenate(checks), np.concatenate([out[later], *stem_slots]))
        return out

    @staticmethod
    def keys(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each piece."""
        raw, offsets = text_bytes(pieces)
        return tuple(word_hashes(raw, offsets[:-1], offsets[1:], lane=lane) for lane in range(2))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with the end id; and the n+1 offsets."""
        self.tidy()
        raw, offsets = text_bytes(texts)
        # a text begins a piece, and so do spaces and line breaks
        cut = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
        first = np.searchsorted(cut, offsets[:-1]) + np.arange(len(texts))
        begin = np.empty(len(cut) + len(texts) + 1, np.int64)
        of_text = np.zeros(len(begin), dtype=bool)
        of_text[first] = True
        of_text[-1] = True
        begin[of_text], begin[~of_text] = offsets, cut
        first = np.append(first, len(begin) - 1)
        coded = pa.LargeStringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), pa.py_buffer(raw)).dictionary_encode()
        pieces, index = coded.dictionary, coded.indices.to_numpy()
        # nothing at all, or more white space, in the widest sense, at either end
        lead = pc.is_in(pc.utf8_slice_codeunits(pieces, 0, 1), pa.array([" ", "\n"], pa.large_string())).to_numpy(zero_copy_only=False)
        inner = pc.binary_length(pc.utf8_trim_whitespace(pieces)).to_numpy()
        bare = (inner == 0) | (inner + lead < pc.binary_length(pieces).to_numpy())
        bad = np.concatenate(([0], np.cumsum(bare[index])))
        odd = bad[first[1:]] > bad[first[:-1]]
        count = np.diff(first)
        plain = np.repeat(~odd, count)
        need = np.zeros(len(pieces), dtype=bool)
        need[index[plain]] = True
        need = np.flatnonzero(need)
        slot = np.zeros(len(pieces), np.int64)
        if len(need):
            some = pieces.take(pa.array(need))
            key, check = self.keys(some)
            found = self.find(key, check)
            if len(gone := np.flatnonzero(found < 0)):
                found[gone] = self.new(some.take(pa.array(gone)), key[gone], check[gone])
            slot[need] = found
        used = slot[index]
        if odd.any():
            whole = self.listed([e.ids for e in self.tokenizer.encode_batch_fast([texts[int(k)].as_py() or "" for k in np.flatnonzero(odd)], add_special_tokens=False)])
            order = np.argsort(np.concatenate([np.flatnonzero(plain), first[:-1][odd]]), kind="stable")
            used, count = np.concatenate([used[plain], whole])[order], np.where(odd, 1, count)
        # the ids of all entries in one run, and the end id behind each text
        start = self.at[used]
        size = self.at[used + 1] - start
        upto = np.concatenate(([0], np.cumsum(size)))
        ends = upto[np.cumsum(count)] + np.arange(len(texts))
        ids = np.full(int(upto[-1]) + len(texts), END_ID, np.uint32)
        real = np.ones(len(ids), dtype=bool)
        real[ends] = False
        ids[real] = self.ids[ragged(start, size)]
        return ids, np.concatenate(([0], ends + 1))


def repair(ids: np.ndarray, offsets: np.ndarray, terminals: int, rules: int = RULES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets, rules): pairs inside documents, replaced while they are frequent. Symbol terminals + k is rule k.

    A round replaces every place of its pairs or takes a neighbour away; the counts of other pairs only fall. So once a round
    has taken all frequent pairs, the next one looks at places with a new symbol alone.
    """
    seq, at = ids.astype(np.uint32), offsets.astype(np.int64)
    made: list[np.ndarray] = []
    base = terminals
    last = np.zeros(len(seq), dtype=bool)  # places that end their document
    last[at[at > 0] - 1] = True
    where = np.flatnonzero(~last)
    while len(where):
        key = (seq[where].astype(np.uint64) << np.uint64(32)) | seq[where + 1]
        bits = min(21, max(8, len(where).bit_length()))
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        # a pair is as frequent as its slot at most; in full slots, numbered anew, one pair is counted by slot, others by their names
        full = np.bincount(slot, minlength=1 << bits) >= least
        full = np.flatnonzero(full)
        number, slots = np.full(1 << bits, -1, np.int32), len(full)
        number[full] = np.arange(slots)
        slot = number[slot]
        full = np.flatnonzero(slot >= 0)
        where, key, slot = where[full], key[full], slot[full]
        chosen = np.zeros(slots, np.uint64)
        chosen[slot] = key
        own = chosen[slot] == key
        count = np.bincount(slot[own], minlength=slots)
        others, other_count = np.unique(key[~own], return_counts=True)
        often = np.flatnonzero(count >= least)
        pairs = np.concatenate([chosen[often], others[other_count >= least]])
        if not len(pairs):
            break
        times = np.concatenate([count[often], other_count[other_count >= least]])
        every = len(pairs) <= rules
        pairs = np.sort(pairs if every else pairs[np.lexsort((pairs, -times))[:rules]])
        rule_of = np.full(slots, -1, np.int64)
        mine = np.minimum(np.searchsorted(pairs, chosen[often]), len(pairs) - 1)
        rule_of[often] = np.where(pairs[mine] == chosen[often], mine, -1)
        rule = np.where(own, rule_of[slot], -1)
        if len(others):
            mine = np.minimum(np.searchsorted(pairs, key[~own]), len(pairs) - 1)
            rule[~own] = np.where(pairs[mine] == key[~own], mine, -1)
        hit = rule >= 0
        where, rule = where[hit], rule[hit]
        # of overlapping places the 1st, 3rd, ... of each chain
        begin = np.concatenate(([True], np.diff(where) > 1))
        head = np.flatnonzero(begin)[np.cumsum(begin) - 1]
        take = (np.arange(len(where)) - head) & 1 == 0
        where, rule = where[take], rule[take]
        seq[where] = base + rule
        last[where] = last[where + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[where + 1] = False
        seq, last = seq[keep], last[keep]
        at = at - np.searchsorted(where + 1, at)
        made.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        base += len(pairs)
        if every:
            new = where - np.arange(len(where))
            look = np.stack([new - 1, new], axis=1).reshape(-1)
            look = look[np.concatenate(([True], look[1:] > look[:-1])) & (look >= 0)]
            where = look[~last[look]]
        else:
            where = np.flatnonzero(~last)
    return seq, at, np.concatenate(made) if made else np.empty((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Ids of each rule. Rules of a round only use symbols of the rounds before it."""
    out = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    size = lambda s: np.where(s < terminals, 1, out[np.maximum(s.astype(np.int64) - terminals, 0)])
    while len(todo):
        a, b = size(rules[todo, 0]), size(rules[todo, 1])
        ready = (a > 0) & (b > 0)
        out[todo[ready]] = (a + b)[ready]
        todo = todo[~ready]
    return out


def pack(doc_ids: list[int | None], ids: np.ndarray, offsets: np.ndarray, terminals: int) -> bytes:
    symbols, at, rules = repair(ids, offsets, terminals)
    z = zstandard.ZstdCompressor(level=1)
    blocks = [z.compress(symbols[k : k + BLOCK].astype("<u4").tobytes()) for k in range(0, len(symbols), BLOCK)]
    head = np.array([len(doc_ids), len(rules), len(symbols), len(ids), terminals], "<u8").tobytes()
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    ends = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8").tobytes()
    return b"".join([_MAGIC, head, keys, at.astype("<u8").tobytes(), rules.astype("<u4").tobytes(), expansion_lengths(rules, terminals).astype("<u4").tobytes(), ends, *blocks])


class Shard:
    """Reads a payload; decodes documents or single ids on their own."""

    def __init__(self, payload: bytes):
        if payload[:8] != _MAGIC:
            raise ValueError("not a token shard")
        n, r, self.n_symbols, self.n_ids, self.terminals = map(int, np.frombuffer(payload, "<u8", 5, 8))
        at = 48
        take = lambda kind, k: np.frombuffer(payload, kind, k, at)
        ids = take("<i8", n)
        at += 8 * n
        self.doc_ids = [None if gone else int(d) for d, gone in zip(ids, take("u1", n), strict=True)]
        at += n
        self.first = take("<u8", n + 1).astype(np.int64)
        at += 8 * (n + 1)
        self.rules = take("<u4", 2 * r).reshape(r, 2)
        at += 8 * r
        self.lengths = take("<u4", r).astype(np.int64)
        at += 4 * r
        blocks = -(-self.n_symbols // BLOCK)
        self.ends = take("<u8", blocks + 1).astype(np.int64)
        self.body = memoryview(payload)[at + 8 * (blocks + 1) :]
        self.z = zstandard.ZstdDecompressor()

    def symbols(self, a: int, b: int) -> np.ndarray:
        parts = [np.frombuffer(self.z.decompress(self.body[self.ends[k] : self.ends[k + 1]]), "<u4") for k in range(a // BLOCK, -(-b // BLOCK))]
        return np.concatenate(parts)[a % BLOCK : a % BLOCK + b - a] if parts else np.empty(0, np.uint32)

    def size(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols >= self.terminals
        out = np.ones(len(symbols), np.int64)
        out[rule] = self.lengths[symbols[rule].astype(np.int64) - self.terminals]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        while len(symbols) and (rule := symbols >= self.terminals).any():
            width = np.where(rule, 2, 1)
            put = np.cumsum(width) - width
            out = np.empty(int(width.sum()), np.uint32)
            out[put[~rule]] = symbols[~rule]
            both = self.rules[symbols[rule].astype(np.int64) - self.terminals]
            out[put[rule]], out[put[rule] + 1] = both[:, 0], both[:, 1]
            symbols = out
        return symbols

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols(int(self.first[k]), int(self.first[k + 1])))

    def id_at(self, k: int, place: int) -> int:
        """Id number `place` of document k; only the symbol that holds it is expanded."""
        symbols = self.symbols(int(self.first[k]), int(self.first[k + 1]))
        ends = np.cumsum(self.size(symbols))
        j = int(np.searchsorted(ends, place, side="right"))
        return int(self.expand(symbols[j : j + 1])[place - (ends[j - 1] if j else 0)])

    def everything(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n+1 offsets of the documents."""
        symbols = self.symbols(0, self.n_symbols)
        start, flat = self.expansions()
        size = self.size(symbols)
        rule = symbols >= self.terminals
        begin = np.empty(len(symbols), np.int64)  # ids of rules lie in flat, others behind it
        begin[rule] = start[symbols[rule].astype(np.int64) - self.terminals]
        begin[~rule] = len(flat) + np.arange(len(symbols) - int(rule.sum()))
        out = np.concatenate([flat, symbols[~rule]])[ragged(begin, size)]
        return out, np.concatenate(([0], np.cumsum(size)))[self.first]

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each rule begin, and the ids of all rules."""
        start = np.cumsum(self.lengths) - self.lengths
        flat = np.empty(int(self.lengths.sum()), np.uint32)
        todo, ready = np.arange(len(self.rules)), np.zeros(len(self.rules), dtype=bool)
        simple = self.rules < self.terminals
        index = np.where(simple, 0, self.rules.astype(np.int64) - self.terminals)
        while len(todo):
            now = todo[(simple[todo] | ready[index[todo]]).all(axis=1)]
            put = start[now]
            for side in range(2):
                one, many = simple[now, side], now[~simple[now, side]]
                flat[put[one]] = self.rules[now[one], side]
                size = self.lengths[index[many, side]]
                flat[ragged(put[~one], size)] = flat[ragged(start[index[many, side]], size)]
                put = put + np.where(one, 1, self.lengths[index[now, side]])
            ready[now] = True
            todo = todo[~ready[todo]]
        return start, flat


def _write(path: str, terminals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("tokenizer", path), lambda: Encoder(path))
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        number, held = TaskContext.get().partitionId() << 32, 0

        def flush() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
            ids = np.concatenate(parts)
            out = pa.RecordBatch.from_pydict({"shard": [number], "n_ids": [len(ids)], "payload": pa.array([pack(keys, ids, offsets, terminals)], pa.binary())})
            released()
            return out

        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                ids, offsets = encoder.encode(part.column("text"))
                keys.extend(part.column("doc_id").to_pylist())
                parts.append(ids)
                counts.append(np.diff(offsets))
                held += len(ids)
                if held >= SHARD_IDS:
                    yield flush()
                    number, held = number + 1, 0
                    keys, parts, counts = [], [], []
        if keys:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, path: str, terminals: int = 65_536) -> None:
    """Shards of docs (doc_id, text) at `path`, a Parquet table (shard, n_ids, payload); shards are numbered in id order."""
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-total // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    ordered.select("doc_id", "text").mapInArrow(lean(_write(tokenizer, terminals)), "shard long, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, payload in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
            shard = Shard(payload.as_py())
            ids, at = shard.everything()
            raw = memoryview(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.full(len(shard.doc_ids), number)), "doc_id": pa.array(shard.doc_ids, pa.int64()), "before": at[:-1].astype(np.int64), "n_tokens": np.diff(at).astype(np.int64),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
            })


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards at `path`."""
    files = spark.read.schema("shard long, n_ids long, payload binary").parquet(path)
    begins = files.select("shard", "n_ids").select("shard", (F.sum("n_ids").over(W.orderBy("shard")) - F.col("n_ids")).alias("begin"))
    docs = files.select("shard", "payload").mapInArrow(lean(_read), "shard long, doc_id long, before long, n_tokens long, ids_crc32 long")
    return docs.join(begins, "shard").select("doc_id", (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards of docs and reads them back."""
    path = shared_dir(docs.sparkSession)
    write(docs, tokenizer or default_tokenizer(), path)
    return read(docs.sparkSession, path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
