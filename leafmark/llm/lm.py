"""Language-model scores from an Elias-Fano n-gram trie that is spread over shards.

Texts are cut into chunks of about CHUNK tokens, each with a dictionary of its own, kept in the shared folder. Every step
after that is a shuffle of requests and answers: a chunk sends each distinct word, pair and triple it holds, with how often
its training texts hold it, to the shard in charge; the shard sums the counts of all chunks, writes its part of the level,
maps it into memory and answers each chunk from it. So a task opens one chunk or one shard, whatever the size of the corpus,
and a distinct n-gram is looked up once a shard.

A shard of words keeps the ascending hashes of its words, Elias-Fano coded, with their counts; the places number the words.
A shard of pairs or triples keeps the keys of its contexts, monotone pointers to where their successors begin, and the
successors themselves, made monotone over the shard by adding the last value of the context before; all three are
Elias-Fano coded. A triple's context is its first word and the place of the second among that word's successors, and its
last word is stored and searched for as its place among the second word's successors. Discounted probabilities and back-off
weights are kept as logarithms of 16 bits.

A context that is too frequent for one shard (the end of a text, a very common word or pair) is counted in pieces first;
the sums go to several shards, and each of these answers a share of the chunks.

p(w|h) is the discounted share of w after h and, times h's back-off weight, p of the shorter context, down to
p(w) = (c + 0.1) / (N + 0.1 (V + 1)). N-grams seen
fewer than min_ngram times in training are left to the shorter contexts, their mass is in the back-off weights. It is two:
an n-gram seen once speaks for the one text it stands in, and would raise that very text above all texts held out.

Tokens: A-Z lower-cased, split at \\x20 and \\x09-\\x0D, then one end, which is also the context of the first token. Null and
empty texts are the end alone. A document is held out if crc32 of its id as text is divisible by `folds`; one with a null
id is held out. Repeated rows count as often as they stand. Without any training document every count is zero. Other
columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import dropped, fresh_dir, removed, shuffles_freed, stored
from leafmark.llm.eliasfano import EliasFano, build

END = 0xE4D0_0F7E_70E4_D001
DISCOUNT, ALPHA = 0.6, 0.1
#: Training tokens for each shard of pairs or triples, and dictionary entries for each shard of words, about.
SHARD_TOKENS, SHARD_WORDS = 2_000_000, 2_000_000
#: Steps of stored log probabilities, from 0 down to -16.
STEP = 16 / 65535
#: Tokens of a chunk, about, and texts that are split together.
CHUNK, BATCH = 2_000_000, 256
#: How hard zstd tries on what waits in the shared folder: a few CPU seconds a GB more than the least, and 5 % fewer bytes.
LEVEL = 9
#: Requests for pairs and triples are answered in so many turns, and chunks get their answers in so many shares, so that disks
#: hold the shuffle of one turn or share at a time.
#: Requests of a level are made in so many rounds of turns: those of one round wait in the shared folder together. A round reads all chunks
#: again, so only triples, which are the most, take two.
PASSES, SHARES, ROUNDS = 6, 3, {3: 2}
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: What goes between chunks and shards. Answers also say how many words or n-grams of training texts the shard has met (seen)
#: and kept, and the highest count of these (top).
ROWS = "shard long, chunk string, kind int, blob binary, seen long, kept long, top long"
_ARROW = pa.schema([("shard", pa.int64()), ("chunk", pa.string()), ("kind", pa.int32()), ("blob", pa.binary()), ("seen", pa.int64()), ("kept", pa.int64()), ("top", pa.int64())])


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, and where each text's end token stands."""
    flat, ends = [], []
    for t in texts:
        if t:
            flat += t.encode("utf-8", "surrogatepass").lower().split()
        ends.append(len(flat) + len(ends))
    words = np.empty(len(flat), object)
    words[:] = flat
    h = pd.util.hash_array(words, categorize=False) if len(flat) else np.empty(0, np.uint64)
    ends = np.array(ends, np.int64)
    out = np.full(len(h) + len(ends), END, np.uint64)
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask] = h
    return out, ends


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low) of the distinct pairs in ascending order, and the number of each row's. Both are from 0 on, low below 2**32.
    Sorted with their places in the same 64 bits where these suffice, which takes half the time."""
    if not len(high):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    under, place = int(low.max()).bit_length(), (len(high) - 1).bit_length()
    if int(high.max()).bit_length() + under + place <= 64:
        x = high.astype(np.uint64) << np.uint64(under) | low.astype(np.uint64)
        x = x << np.uint64(place) | np.arange(len(x), dtype=np.uint64)
        x.sort()
        at = (x & np.uint64((1 << place) - 1)).astype(np.int64)
        x >>= np.uint64(place)
        first = np.r_[True, x[1:] != x[:-1]]
        back = np.empty(len(x), np.int64)
        back[at] = np.cumsum(first) - 1
        u = x[first]
    else:
        under = 32
        u, back = np.unique(high.astype(np.uint64) << np.uint64(under) | low.astype(np.uint64), return_inverse=True)
    return (u >> np.uint64(under)).astype(np.int64), (u & np.uint64((1 << under) - 1)).astype(np.int64), back


def runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of what ascends already, and the number of each row's."""
    first = np.r_[True, ascending[1:] != ascending[:-1]][: len(ascending)]
    return ascending[first], np.cumsum(first) - 1


# arrays in one piece of bytes
def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """A length, a JSON head (name, type, length, place), and the arrays at multiples of 8 bytes."""
    head, at, body = [], 0, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        head.append((name, np.asarray(a).dtype.str, len(np.asarray(a).ravel()), at))
        data += bytes(-len(data) % 8)
        body.append(data)
        at += len(data)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *body])


def unpacked(data) -> dict[str, np.ndarray]:
    n = int.from_bytes(bytes(data[:8]), "little")
    return {name: np.frombuffer(data, kind, size, 8 + n + at) for name, kind, size, at in json.loads(bytes(data[8 : 8 + n]))}


def sent(arrays: dict[str, np.ndarray]) -> bytes:
    """packed() and compressed, for the ways between chunks and shards. Bytes of one rank stand together, as they are much alike."""
    kinds = {k: np.asarray(a).dtype.str for k, a in arrays.items()}
    planes = {f"{k} {kinds[k]}": np.ascontiguousarray(np.asarray(a)).view(np.uint8).reshape(-1, np.asarray(a).itemsize).T.ravel() for k, a in arrays.items()}
    raw = packed(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def received(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, a in unpacked(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)).items():
        key, kind = name.split(" ")
        out[key] = np.ascontiguousarray(a.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return out


def steps_of(value: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Values that ascend within groups of so many as their differences, the first of a group as it is."""
    out = np.diff(np.r_[0, value.astype(np.int64)])
    first = np.cumsum(each.astype(np.int64)) - each
    first = first[each > 0]
    out[first] = value[first]
    return out


def from_steps(steps: np.ndarray, each: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps.astype(np.int64))
    each = each[each > 0].astype(np.int64)
    first = np.cumsum(each) - each
    return total - np.repeat(np.r_[0, total][first], each)


def split_key(key: np.ndarray) -> dict[str, np.ndarray]:
    """Ascending 64-bit keys as the steps of their upper halves, and their lower halves."""
    upper = (key >> np.uint64(32)).astype(np.int64)
    return {"upper": narrow(np.diff(np.r_[0, upper])), "under": narrow(key & np.uint64(0xFFFFFFFF))}


def joined_key(arrays: dict[str, np.ndarray]) -> np.ndarray:
    return np.cumsum(arrays["upper"], dtype=np.uint64) << np.uint64(32) | arrays["under"].astype(np.uint64)


def by_frequency(classes: np.ndarray) -> np.ndarray:
    """Words by falling class, and within a class as they stood."""
    return np.argsort(-classes.astype(np.int16), kind="stable")


def numbered(local: np.ndarray, words: int) -> dict[str, np.ndarray]:
    """The words of a chunk's tokens, numbered so that frequent ones come first: their upper bytes are mostly zeros then, and
    take little room. How frequent a word is (the logarithm of its count) restores the order of words."""
    classes = np.frexp(np.bincount(local, minlength=words))[1].astype(np.uint8)
    rank = np.empty(words, np.int64)
    rank[by_frequency(classes)] = np.arange(words)
    return {"classes": classes, "ranks": narrow(rank[local])}


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as they need."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _store(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Renamed when complete, so tasks that run twice do no harm."""
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    tmp = f"{root}/.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(packed(arrays))
    store.move(tmp, f"{root}/{name}")


def _load(folder: str, name: str) -> dict[str, np.ndarray]:
    """Mapped where the folder is a mounted one; read where it is a remote store. It is one shard, whose size is bounded."""
    from pyarrow import fs

    store, root = _filesystem(folder)
    if isinstance(store, fs.LocalFileSystem):
        return unpacked(np.memmap(f"{root}/{name}", np.uint8, "r"))
    with store.open_input_stream(f"{root}/{name}") as f:
        return unpacked(f.read())


def quantised(logp: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logp / STEP), 0, 65535).astype(np.uint16)


class Trie:
    """A shard of a level: contexts, pointers, successors, and the logs of both."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        part = lambda name: EliasFano({k: arrays[f"{name}.{k}"] for k in ("meta", "high", "ones", "low")})
        self.contexts, self.pointers, self.values = part("contexts"), part("pointers"), part("values")
        self.logs, self.weights = arrays["logs"], arrays["weights"]

    @staticmethod
    def arrays(contexts: np.ndarray, owner: np.ndarray, value: np.ndarray, logs: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """owner: number of the context of each successor; both ascend, and value within an owner. No context is without one."""
        pointers = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(contexts)))].astype(np.int64)
        values = value.astype(np.uint64) + np.uint64(1)
        tops = np.r_[np.uint64(0), np.cumsum(values[pointers[1:] - 1], dtype=np.uint64)[:-1]] if len(contexts) else np.zeros(0, np.uint64)
        values = values + np.repeat(tops, np.diff(pointers))
        out = {"logs": logs, "weights": weights}
        for name, x in (("contexts", contexts), ("pointers", pointers), ("values", values)):
            out |= {f"{name}.{k}": a for k, a in build(x.astype(np.uint64)).items()}
        return out

    def find(self, contexts: np.ndarray, owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weight of each context in steps, place of each value or -1, place among its context's successors).
        owner: which of the contexts asked for each value belongs to."""
        node = self.contexts.find(contexts)
        known = np.flatnonzero(node >= 0)
        weight, first, last, base = np.zeros(len(node), np.uint16), np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.zeros(len(node), np.uint64)
        weight[known] = self.weights[node[known]]
        first[known] = self.pointers.access(node[known]).astype(np.int64)
        last[known] = self.pointers.access(node[known] + 1).astype(np.int64)
        later = known[first[known] > 0]
        base[later] = self.values.access(first[later] - 1)
        place = np.full(len(value), -1, np.int64)
        ask = np.flatnonzero(node[owner] >= 0)
        who = owner[ask]
        at = self.values.find(base[who] + value[ask].astype(np.uint64) + np.uint64(1))
        good = (at >= first[who]) & (at < last[who])
        place[ask[good]] = at[good]
        return weight, place, place - first[owner]


# chunks
def _encode(folder: str, names: str, size: int = CHUNK):
    """Writes the chunks of a task into one file and tells where each is: (chunk, dictionary, tokens, training, words). The hashes
    of their words stand in a file in another folder, for they are needed only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        other = _filesystem(names)[1]
        for x in (root, other):
            store.create_dir(x, recursive=True)
        name = uuid.uuid4().hex
        kept: list[tuple] = []
        at = {}

        def put(file, data: bytes) -> str:
            low = at.get(file, 0)
            at[file] = low + len(data)
            file.write(data)
            return f"{name}:{low}:{len(data)}"

        def flush(file, words_file) -> pa.RecordBatch:
            nonlocal kept
            ids, held, h, lengths = (np.concatenate(x) for x in zip(*[(i, b, h, n) for i, b, h, n, _ in kept]))
            null = np.concatenate([k[4] for k in kept])
            words, local = np.unique(h, return_inverse=True)
            key = put(file, sent({"doc": ids, "null": null, "held": held, "lengths": narrow(lengths)} | numbered(local, len(words))))
            dictionary = put(words_file, words.tobytes())
            kept = []
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([dictionary]), *[pa.array([int(x)], pa.int64()) for x in (len(h), lengths[~held].sum(), len(words))]], names=["chunk", "dictionary", "tokens", "training", "words"])

        with store.open_output_stream(f"{root}/.{name}") as file, store.open_output_stream(f"{other}/.{name}") as words_file:
            for b in batches:
                for k in range(0, b.num_rows, BATCH):
                    part = b.slice(k, BATCH)
                    h, ends = hashed(part.column(2).to_pylist())
                    docs = part.column(0)
                    kept.append((docs.fill_null(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), h, np.diff(np.r_[-1, ends]), docs.is_null().to_numpy(zero_copy_only=False)))
                    if sum(len(x[2]) for x in kept) >= size:
                        yield flush(file, words_file)
            if kept:
                yield flush(file, words_file)
        for x in (root, other):
            store.move(f"{x}/.{name}", f"{x}/{name}")

    return run


def _piece(folder: str, key: str) -> bytes:
    store, root = _filesystem(folder)
    name, at, n = key.split(":")
    with store.open_input_file(f"{root}/{name}") as f:
        return f.read_at(int(n), int(at))


def _chunk(folder: str, key: str) -> dict[str, np.ndarray]:
    out = received(_piece(folder, key))
    out["ids"] = by_frequency(out.pop("classes"))[out.pop("ranks")]
    return out | {"lengths": out["lengths"].astype(np.int64), "held": out["held"].astype(bool), "null": out["null"].astype(bool)}


def _rows(rows: list[tuple], seen: int = 0, kept: int = 0, top: int = 0) -> pa.RecordBatch:
    """rows: (shard, chunk, kind, blob)."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW[k].type) for k in range(4)] + [pa.array([x] * len(rows), pa.int64()) for x in (seen, kept, top)], schema=_ARROW)


# words
def _ask_words(info: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, dictionary in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c, words = _chunk(info["chunks"], key), np.frombuffer(_piece(info["names"], dictionary), np.uint64)
                training = np.repeat(~c["held"], c["lengths"])
                n = np.bincount(c["ids"][training], minlength=len(words))
                shard = (words >> np.uint64(64 - info["bits"])).astype(np.int64) if info["bits"] else np.zeros(len(n), np.int64)
                ids, first = np.unique(shard, return_index=True)
                cuts = np.r_[first, len(n)]
                yield _rows([(s, key, 1, sent({"h": words[i:j], "n": narrow(n[i:j])})) for s, i, j in zip(ids.tolist(), cuts[:-1], cuts[1:])])

    return run


def _words(info: dict):
    """Level 1 of a shard. An answer: `code` (count, min_ngram for all from there on), and place and count of those kept."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        asked = [received(x) for x in group.column("blob").to_pylist()]
        u, back = np.unique(np.concatenate([a["h"] for a in asked]), return_inverse=True)
        n = np.bincount(back, np.concatenate([a["n"] for a in asked])).astype(np.int64)
        kept = n >= info["least"]
        place = np.cumsum(kept) - 1
        _store(info["folder"], f"1-{key[0].as_py()}", {f"words.{k}": a for k, a in build(u[kept]).items()} | {"counts": narrow(n[kept])})
        rows, low = [], 0
        for chunk, a in zip(group.column("chunk").to_pylist(), asked):
            own = back[low : low + len(a["h"])]
            low += len(own)
            k = own[kept[own]]
            rows.append((key[0].as_py(), chunk, 1, sent({"code": narrow(np.minimum(n[own], info["least"])), "place": narrow(np.diff(np.r_[0, place[k]])), "n": narrow(n[k])})))
        return pa.Table.from_batches([_rows(rows, int((n > 0).sum()), int(kept.sum()), int(n.max()))])

    return run


# requests of a level
class Request:
    """Contexts (key, total) and their values (owner, value, n) as they go to shards; owners ascend, and values within an owner.
    total is how often training texts hold the context, local how often those of this chunk do; the latter is sent, and summed
    by the shard, but for contexts that several shards share."""

    def __init__(self, info: dict, chunk: str, key, total, local, owner, value, n):
        parts = parts_of(info, total)
        self.key, self.total, self.owner, self.value, self.n = key, np.where(parts > 1, total, local), owner, value, n
        share = np.uint64(zlib.crc32(chunk.encode())) % parts
        self.shard, self.hot = route(info, key, share), parts > 1
        self.by_context = np.argsort(self.shard, kind="stable")
        self.by_value = np.argsort(self.shard[owner], kind="stable")

    def blobs(self, turns: range) -> Iterator[tuple[int, bytes]]:
        """What goes to the shards of these turns."""
        each = np.bincount(self.owner, minlength=len(self.key))
        ids, first = np.unique(self.shard[self.by_context], return_index=True)
        low = np.searchsorted(self.shard[self.owner][self.by_value], np.r_[ids, np.iinfo(np.int64).max])
        cuts = np.r_[first, len(self.key)]
        for k, s in enumerate(ids.tolist()):
            if s % PASSES not in turns:
                continue
            c, v = self.by_context[cuts[k] : cuts[k + 1]], self.by_value[low[k] : low[k + 1]]
            yield s, sent(split_key(self.key[c]) | {"total": narrow(self.total[c]), "each": narrow(each[c]), "value": narrow(steps_of(self.value[v], each[c])), "n": narrow(self.n[v])})

    def hot_blobs(self, info: dict) -> Iterator[tuple[int, bytes]]:
        """Training counts of the values of hot contexts, dealt by context and value."""
        v = np.flatnonzero(self.hot[self.owner] & (self.n > 0))
        if len(v):
            o = self.owner[v]
            shard = route(info, mix(self.key[o] ^ _M2), self.value[v].astype(np.uint64))
            for s in np.unique(shard).tolist():
                x, w = o[shard == s], v[shard == s]
                yield s, sent(split_key(self.key[x]) | {"total": narrow(self.total[x]), "each": np.ones(len(x), np.uint8), "value": narrow(self.value[w]), "n": narrow(self.n[w])})

    def answered(self, blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        """(weight of contexts, hit, count, rel of values) from the answers in order of their shards."""
        told = [received(x) for x in blobs]
        weight, hit = np.zeros(len(self.key), np.int64), np.zeros(len(self.value), bool)
        weight[self.by_context] = np.concatenate([t["weight"] for t in told])
        hit[self.by_value] = np.concatenate([np.unpackbits(t["hit"], count=int(t["values"][0])) for t in told])
        out = []
        for name in ("n", "rel"):
            x = np.zeros(len(hit), np.int64)
            x[self.by_value[hit[self.by_value]]] = np.concatenate([t[name] for t in told])
            out.append(x)
        return weight, hit, *out


def parts_of(info: dict, total: np.ndarray) -> np.ndarray:
    """How many shards share a context that occurs so often: one, unless it fills more than half of one."""
    return np.maximum(np.ceil(2 * total.astype(np.float64) * info["shards"] / max(info["tokens"], 1)), 1).astype(np.uint64)


def route(info: dict, key: np.ndarray, share: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(mix(key) + share * _M1) % np.uint64(info["shards"])).astype(np.int64)


class Work:
    """A chunk with the answers it has got so far: told[kind] is a list of (shard, blob)."""

    def __init__(self, info: dict, chunk: str, told: dict[int, list[tuple[int, bytes]]]):
        self.info, self.chunk = info, chunk
        self.told = {k: sorted(v) for k, v in told.items()}
        c = _chunk(info["chunks"], chunk)
        self.doc, self.null, self.held, self.lengths, self.ids = c["doc"], c["null"], c["held"], c["lengths"], c["ids"].astype(np.int64)
        self.training = np.repeat(~self.held, self.lengths)
        start = info["start"]
        count, number = [], []
        for s, blob in self.told[1]:
            t = received(blob)
            n, at = t["code"].astype(np.int64), np.full(len(t["code"]), -1, np.int64)
            kept = n >= info["least"]
            n[kept], at[kept] = t["n"], np.cumsum(t["place"].astype(np.int64)) + start[s]
            count.append(n)
            number.append(at)
        self.count, self.number = np.concatenate(count), np.concatenate(number)
        self.log1 = np.log10((self.count + ALPHA) / (info["tokens"] + ALPHA * (info["words"] + 1)))
        self.first = np.zeros(len(self.ids), bool)
        self.first[np.r_[0, np.cumsum(self.lengths)[:-1]]] = True
        before = np.r_[0, self.ids[:-1]]
        before[self.first] = self.ids[-1]  # a chunk ends with an end token
        # pairs by local numbers, which ascend as the words' numbers do
        self.left, self.right, self.pair = distinct(before, self.ids)
        self.seen = np.bincount(self.pair[self.training], minlength=len(self.left))

    def pairs(self) -> Request:
        known = self.number[self.left] >= 0
        local, where = runs(self.left[known])
        good = self.number[self.right[known]] >= 0
        self.contexts, self.asked = local, np.flatnonzero(known)[good]
        mine = np.bincount(where, self.seen[known], minlength=len(local)).astype(np.int64)
        return Request(self.info, self.chunk, self.number[local].astype(np.uint64) << np.uint64(32), self.count[local], mine, where[good], self.number[self.right[self.asked]], self.seen[self.asked])

    def take_pairs(self) -> None:
        n = len(self.left)
        self.weight1, self.hit = np.zeros(len(self.count)), np.zeros(n, bool)
        self.n, self.rel = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if 2 in self.told:
            weight, self.hit[self.asked], self.n[self.asked], self.rel[self.asked] = self.pairs().answered([b for _, b in self.told[2]])
            self.weight1[self.contexts] = -STEP * weight
        self.share = np.where(self.hit, (self.n - self.info["discount"]) / np.maximum(self.count[self.left], 1), 0)

    def triples(self) -> Request:
        """Contexts are the pairs that stand before another token."""
        later = np.flatnonzero(~self.first)
        a, b = self.pair[later - 1], self.pair[later]
        known = self.hit[a]
        later, a, b = later[known], a[known], b[known]
        self.context_pairs = np.flatnonzero(np.bincount(a))
        both = self.hit[b]
        self.at = later[both]
        x, y, self.triple = distinct(a[both], b[both])
        n = np.bincount(self.triple[self.training[self.at]], minlength=len(x))
        c = self.context_pairs
        key = self.number[self.left[c]].astype(np.uint64) << np.uint64(32) | self.rel[c].astype(np.uint64)
        self.owner = np.searchsorted(c, x)
        return Request(self.info, self.chunk, key, self.n[c], self.seen[c], self.owner, self.rel[y], n)

    def scores(self) -> np.ndarray:
        """log10 p of every token."""
        self.take_pairs()
        # by distinct pairs first, and by distinct triples: tokens only gather
        p2 = self.share + 10 ** (self.weight1[self.left] + self.log1[self.right])
        out = np.log10(p2)[self.pair]
        if 3 in self.told:
            weight, hit, n, _ = self.triples().answered([b for _, b in self.told[3]])
            weight2 = np.zeros(len(self.left))
            weight2[self.context_pairs] = -STEP * weight
            later = np.flatnonzero(~self.first)
            out[later] += weight2[self.pair[later - 1]]
            share = np.where(hit, (n - self.info["discount"]) / np.maximum(self.n[self.context_pairs[self.owner]], 1), 0)[self.triple]
            out[self.at] = np.where(share > 0, np.log10(share + 10 ** out[self.at]), out[self.at])
        return out


def _keep(info: dict):
    """Rows in order of their chunk: puts the answers that a chunk has got into one file of the task, so that they need not be
    shuffled again, and tells where they are: rows of kind 9."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(info["known"])
        store.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        at, chunk, rows = 0, None, []

        def flush(file) -> pa.RecordBatch:
            nonlocal at
            data = packed({"kind": np.array([r[0] for r in rows], np.int64), "shard": np.array([r[1] for r in rows], np.int64), "size": np.array([len(r[2]) for r in rows], np.int64), "data": np.frombuffer(b"".join(r[2] for r in rows), np.uint8)})
            file.write(data)
            at += len(data)
            return _rows([(0, chunk, 9, f"{name}:{at - len(data)}:{len(data)}".encode())])

        with store.open_output_stream(f"{root}/.{name}") as file:
            for b in batches:
                for key, kind, shard, blob in zip(*(b.column(c).to_pylist() for c in ("chunk", "kind", "shard", "blob"))):
                    if rows and key != chunk:
                        yield flush(file)
                        rows = []
                    chunk = key
                    rows.append((kind, shard, blob))
            if rows:
                yield flush(file)
        store.move(f"{root}/.{name}", f"{root}/{name}")

    return run


def _work(info: dict, key: tuple, group: pa.Table) -> Work:
    told: dict[int, list] = {}
    for kind, shard, blob in zip(*(group.column(c).to_pylist() for c in ("kind", "shard", "blob"))):
        if kind == 9:
            t = unpacked(_piece(info["known"], blob.decode()))
            data, cuts = t["data"].tobytes(), np.r_[0, np.cumsum(t["size"])]
            for k, s, i, j in zip(t["kind"].tolist(), t["shard"].tolist(), cuts[:-1], cuts[1:]):
                told.setdefault(k, []).append((s, data[i:j]))
        else:
            told.setdefault(kind, []).append((shard, blob))
    return Work(info, key[0].as_py(), told)


def _ask(info: dict, level: int, hot: bool, turns: range):
    """Requests of a chunk at a level in these turns; with hot also (kind 2) the training counts of contexts that several shards
    share, to any shard."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        w = _work(info, key, group)
        if level == 3:
            w.take_pairs()
        request = w.triples() if level == 3 else w.pairs()
        rows = [(s, w.chunk, 0, b) for s, b in request.blobs(turns)]
        if hot:
            rows += [(s, w.chunk, 2, b) for s, b in request.hot_blobs(info)]
        return pa.Table.from_batches([_rows(rows)], _ARROW)

    return run


def _each(run):
    """run for groups of one row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = pa.Table.from_batches([b.slice(k, 1)])
                yield from run((row.column("chunk")[0],), row).to_batches()

    return each


def _shared(info: dict):
    """Sums the counts of hot contexts' values and sends those kept to every shard that answers for the context."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        asked = [received(x) for x in group.column("blob").to_pylist()]
        context, total, value, n = (np.concatenate([joined_key(a) if k == "key" else a[k] for a in asked]) for k in ("key", "total", "value", "n"))
        contexts, first, owner = np.unique(context, return_index=True, return_inverse=True)
        u, at, back = np.unique(owner.astype(np.uint64) << np.uint64(32) | value.astype(np.uint64), return_index=True, return_inverse=True)
        sums = np.bincount(back, n)
        kept = sums >= info["least"]
        owner, value, sums = (u[kept] >> np.uint64(32)).astype(np.int64), value[at[kept]], sums[kept].astype(np.int64)
        total = total[first]
        parts = parts_of(info, total)
        target = np.concatenate([np.stack([np.flatnonzero(parts > p), route(info, contexts[parts > p], np.full(int((parts > p).sum()), p, np.uint64))], 1) for p in range(int(parts.max()))])
        target = np.unique(target[:, ::-1], axis=0)  # (shard, context), once each
        rows = []
        for s in np.unique(target[:, 0]).tolist():
            own = np.zeros(len(contexts), bool)
            own[target[target[:, 0] == s, 1]] = True
            v = np.flatnonzero(own[owner])
            names, where = np.unique(owner[v], return_inverse=True)
            if len(v):
                rows.append((s, "", 1, sent(split_key(contexts[names]) | {"total": narrow(total[names]), "each": narrow(np.bincount(where)), "value": narrow(steps_of(value[v], np.bincount(where))), "n": narrow(sums[v])})))
        return pa.Table.from_batches([_rows(rows)], _ARROW)

    return run


def _level(info: dict, level: int):
    """Builds a shard of a level from the requests of all chunks, and answers these from it."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        asked = [received(x) for x in group.column("blob").to_pylist()]
        shared = np.array(group.column("kind").to_pylist()) == 1
        contexts = np.concatenate([joined_key(a) for a in asked])
        upper, lower, back = distinct(contexts >> np.uint64(32), contexts & np.uint64(0xFFFFFFFF))
        contexts = upper.astype(np.uint64) << np.uint64(32) | lower.astype(np.uint64)
        totals, owners = np.concatenate([a["total"] for a in asked]).astype(np.float64), np.repeat(shared, [len(a["under"]) for a in asked])
        total = np.bincount(back, totals, minlength=len(contexts))
        total[back[owners]] = totals[owners]
        sizes = np.array([(len(a["under"]), len(a["value"])) for a in asked])
        owner = np.repeat(back, np.concatenate([a["each"] for a in asked]))
        # what several shards share was summed before; where nothing of it was kept, nothing of a share of it can be
        whole = np.zeros(len(contexts), bool)
        from_shared = np.repeat(shared, sizes[:, 1])
        whole[owner[from_shared]] = True
        n = np.concatenate([a["n"] for a in asked]).astype(np.float64)
        n[whole[owner] & ~from_shared] = 0
        owner, value, inverse = distinct(owner, np.concatenate([from_steps(a["value"], a["each"]) for a in asked]))
        n = np.bincount(inverse, n, minlength=len(owner))
        kept = np.flatnonzero(n >= info["least"])
        gain = (n[kept] - info["discount"]) / total[owner[kept]]
        weight = np.maximum(1 - np.bincount(owner[kept], gain, minlength=len(contexts)), 1e-9)
        names, node = runs(owner[kept])
        place = f"{level}-{key[0].as_py()}"
        _store(info["folder"], place, Trie.arrays(contexts[names], node, value[kept], quantised(np.log10(gain)), quantised(np.log10(weight[names]))))
        trie = Trie(_load(info["folder"], place))
        steps, at, rel = trie.find(contexts, owner, value)
        # counts go in fewer bytes than logarithms: to the unit below some 1,700, and beyond that as near as the logarithms are
        logs = trie.logs[np.maximum(at, 0)] if len(trie.logs) else np.zeros(len(at), np.uint16)
        told = np.rint(10 ** (-STEP * logs) * total[owner] + info["discount"]).astype(np.int64)
        rows, c, v = [], 0, 0
        for chunk, alone, (nc, nv) in zip(group.column("chunk").to_pylist(), ~shared, sizes.tolist()):
            own = inverse[v : v + nv]
            if alone:
                hit = at[own] >= 0
                h = own[hit]
                none = np.zeros(len(h) if level == 3 else 0, np.uint8)  # only pairs have successors that are numbered by them
                rows.append((key[0].as_py(), chunk, level, sent({"weight": steps[back[c : c + nc]], "values": np.array([nv]), "hit": np.packbits(hit), "n": narrow(told[h]), "rel": none if level == 3 else narrow(rel[h])})))
            c, v = c + nc, v + nv
        return pa.Table.from_batches([_rows(rows, int((n > 0).sum()), len(kept), int(n[kept].max()) if len(kept) else 0)], _ARROW)

    return run


def _scored(info: dict):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        w = _work(info, key, group)
        score, base, known = w.scores(), w.log1[w.ids], w.count[w.ids] > 0
        starts = np.r_[0, np.cumsum(w.lengths)[:-1]]
        return pa.table(
            [pa.array(w.doc, pa.int64(), mask=w.null), pa.array(w.held), pa.array(w.lengths), pa.array(np.add.reduceat(known.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def score(docs: DataFrame, folds: int = 10, order: int = 3, min_ngram: int = 2, discount: float = DISCOUNT, folder: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document. The model is left in folder."""
    spark = docs.sparkSession
    out = F.col("doc_id").isNull() | (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    info = {"folder": folder or fresh_dir(spark, "ngrams"), "chunks": fresh_dir(spark, "tokens"), "names": fresh_dir(spark, "dictionaries"), "known": fresh_dir(spark, "known"), "least": min_ngram, "discount": discount}
    chunks = stored(rows.mapInArrow(_encode(info["chunks"], info["names"]), "chunk string, dictionary string, tokens long, training long, words long"), "chunks")
    all_ = chunks.agg(F.coalesce(F.sum("training"), F.lit(0)).alias("training"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    info |= {"tokens": int(all_.training), "bits": max((int(all_.words) // SHARD_WORDS).bit_length(), (tasks - 1).bit_length()), "shards": max(tasks, -(-int(all_.training) // SHARD_TOKENS))}
    told = stored(chunks.select("chunk", "dictionary").mapInArrow(_ask_words(info), ROWS).groupBy("shard").applyInArrow(_words(info), ROWS), "words")
    removed(spark, info["names"])
    made = told.groupBy("shard").agg(F.max("seen").alias("seen"), F.max("kept").alias("kept"), F.max("top").alias("top")).collect()  # a row for each shard of words
    kept = {r.shard: r.kept for r in made}
    every = [kept.get(s, 0) for s in range(1 << info["bits"])]
    if sum(every) >= 1 << 32:
        raise ValueError("words are numbered in 32 bits; raise min_ngram")
    info |= {"start": np.r_[0, np.cumsum(every)[:-1]].tolist(), "words": sum(r.seen for r in made)}
    top = max((r.top for r in made), default=0)
    share = F.pmod(F.crc32("chunk"), F.lit(SHARES))
    for level in range(2, order + 1):
        hot = 2 * top * info["shards"] > info["tokens"]
        if level == 3:
            # from here on a chunk's answers stand in files, and a row names them: rows are few and small, and dealt out evenly
            words = told
            both = words.unionByName(answers)
            told = reduce(DataFrame.unionByName, [stored(both.where(share == k).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_keep(info), ROWS), "known") for k in range(SHARES)])
            dropped(words, *parts)
        parts, shared, each = [], None, PASSES // ROUNDS.get(level, 1)
        for first in range(0, PASSES, each):
            turns = range(first, first + each)
            ask = _ask(info, level, hot and not first, turns)
            asked = told.groupBy("chunk").applyInArrow(ask, ROWS) if level == 2 else told.repartition(max(tasks, chunks.count())).mapInArrow(_each(ask), ROWS)
            # a chunk makes the requests of a round once; they wait in a folder for each turn, which goes with it
            requests = fresh_dir(spark, "requests")
            with shuffles_freed(spark):
                asked.withColumn("turn", F.when(F.col("kind") == 2, PASSES).otherwise(F.col("shard") % PASSES)).write.partitionBy("turn").parquet(requests)
            waiting = lambda turn: spark.read.schema(f"{ROWS}, turn int").parquet(requests).where(F.col("turn") == turn).drop("turn")  # noqa: B023, E731
            if hot and not first:
                shared = stored(waiting(PASSES).groupBy("shard").applyInArrow(_shared(info), ROWS), "shared")
                removed(spark, f"{requests}/turn={PASSES}")
            for turn in turns:
                mine = waiting(turn) if shared is None else waiting(turn).unionByName(shared.where(F.col("shard") % PASSES == turn))
                parts.append(stored(mine.groupBy("shard").applyInArrow(_level(info, level), ROWS), f"level{level}"))
                removed(spark, f"{requests}/turn={turn}")
            removed(spark, requests)
        if shared is not None:
            dropped(shared)
        answers = reduce(DataFrame.unionByName, parts)
        top = answers.agg(F.max("top")).first()[0] or 0
    if order > 1:
        told = told.unionByName(answers)
    form = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = reduce(DataFrame.unionByName, [stored(told.where(share == k).groupBy("chunk").applyInArrow(_scored(info), form), "scores") for k in range(SHARES)])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(info["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
