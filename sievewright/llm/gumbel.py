"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text's lattice has its characters' gaps as nodes and vocabulary pieces as edges; pieces never reach over a
word's begin, so the lattice is a chain of word lattices, which are built once per distinct word. A backward pass gives
each node its log-sum, hence each edge its conditional probability. The root holds a Gumbel draw; a perturbed
A-star search then splits the space of segmentations: along the best path every step leaves
behind the region "same beginning, another piece here", whose greatest perturbed score is a
Gumbel draw truncated at its parent's. The best region on the frontier gives the next segmentation, so the first k are
the k greatest perturbed scores: a sample without replacement. The (k+1)-th greatest score gives inclusion probabilities.

All draws are hashes of (seed, row key, sample, place), so a row gives the same result in any task. Piece scores of a BPE vocabulary are ranks; they
are read as a Zipf law, log-probabilities of a unigram vocabulary are taken as they are. Characters without a
piece fall back to byte pieces, as one edge.

Null text counts as empty: one segmentation without tokens; where a text has fewer than k segmentations all of
them come, with inclusion 1; null row keys hash as 0; repeated rows repeat their results; texts of any length are segmented whole, word by word; of equal perturbed
scores the region found first is taken; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .recompression import mix

SAMPLES, SEED, ALPHA, SLICE = 2, 20240101, 0.5, 1 << 20
STORE_NODES = 2_500_000
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Vocabulary:
    """Pieces, weights, and a trie over characters as one hash table of (node, character)."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        score = np.array([sp.get_score(i) for i in range(n)], float)
        ranks = len(usable) > 1 and bool(np.all(score[usable] == np.round(score[usable])))
        weight = -np.log(2.7 + np.abs(score)) if ranks else score.copy()
        if ranks:
            weight -= np.log(np.exp(weight[usable]).sum())
        self.weight, self.unknown = weight, float(weight[usable].min() - 10)
        self.byte_ids = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.pieces, self.bare = {}, {}
        self.bytes_of = [b""] * n
        for i in usable:
            p = sp.id_to_piece(i)
            self.pieces[p] = i
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for p, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([int(p[3:5], 16)])
        self.longest = max(map(len, self.pieces), default=1)
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        nodes, table, final = 1, {}, [-1]
        for p, i in self.pieces.items():
            at = 0
            for c in p:
                key = at << 21 | ord(c)
                if key not in table:
                    table[key] = nodes
                    final.append(-1)
                    nodes += 1
                at = table[key]
            final[at] = i
        self.final = np.array(final)
        self.keys = np.array(sorted(table), np.int64)
        self.next = np.array([table[k] for k in self.keys.tolist()], np.int64)
        bits = int(len(self.keys) * 4).bit_length()
        self.shift = np.uint64(64 - bits)
        slot = self._slot(self.keys)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)
        for k, s in enumerate(slot.tolist()):
            while self.slots[s] >= 0:
                s += 1
            self.slots[s] = k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Trie node after ``char``, -1 where there is none."""
        key = node << 21 | char
        slot, out = self._slot(key), np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            k = self.slots[slot[open_]]
            here = k >= 0
            open_, k = open_[here], k[here]
            hit = self.keys[k] == key[open_]
            out[open_[hit]] = self.next[k[hit]]
            open_ = open_[~hit]
            slot[open_] += 1
        return out

    def fallback(self, char: int) -> np.ndarray:
        if char not in self.bare:
            self.bare[char] = np.array([self.byte_ids.get(f"<0x{b:02X}>", self.sp.unk_id()) for b in chr(char).encode()], np.int32)
        return self.bare[char]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """``ids`` with the byte pieces of characters (-1 - character) that have no piece."""
        bare = np.flatnonzero(ids < 0).tolist()
        if not bare:
            return ids
        parts, done = [], 0
        for x in bare:
            parts += [ids[done:x], self.fallback(-1 - int(ids[x]))]
            done = x + 1
        return np.concatenate([*parts, ids[done:]])

    def decode(self, ids: list[int]) -> bytes:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:] if raw[:1] == b" " else raw


class Index(dict):
    """Numbers words as they are met and keeps the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Column:
    """A growing array: appends cost their own length."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1 << 12, dtype), 0

    def append(self, x: np.ndarray) -> np.ndarray:
        """Adds ``x``; returns the whole column."""
        stop = self.n + len(x)
        if stop > len(self.room):
            wider = np.zeros(max(stop, 2 * len(self.room)), self.room.dtype)
            wider[:self.n] = self.room[:self.n]
            self.room = wider
        self.room[self.n:stop] = x
        self.n = stop
        return self.room[:stop]

    def cut(self, n: int) -> np.ndarray:
        self.n = n
        return self.room[:n]


def chunks(normal: str) -> list[str]:
    """Words of a normalised text, each with the spaces before it."""
    if normal[:1] == SPACE and " " not in normal and SPACE * 2 not in normal:
        return normal.replace(SPACE, " " + SPACE).split(" ")[1:]
    return _CHUNK.findall(normal)


class Store:
    """Lattices of distinct words: for each node the range of its edges; for each edge id, length, probability."""

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.v, self.alpha = vocabulary, alpha
        self.odds, self.odds_unknown = np.exp(alpha * vocabulary.weight), float(np.exp(alpha * vocabulary.unknown))
        self.short = int(600 / (abs(alpha * vocabulary.unknown) + 2))  # no product of so many pieces leaves the range of doubles
        self.grow = np.exp(2.0 * np.arange(max(vocabulary.longest, 1) + 1))
        self.clear()

    def clear(self) -> None:
        self.index, self.base = Index(), None
        # first: node of a word's begin; begin: first edge of a node
        self.columns = {k: Column(t) for k, t in (("first", np.int64), ("begin", np.int64), ("ids", np.int32), ("steps", np.int32), ("q", float), ("cdf", float))}
        self._append(first=(), begin=(), ids=(), steps=(), q=(), cdf=())

    def _append(self, **parts) -> None:
        for k, x in parts.items():
            setattr(self, k, self.columns[k].append(x))

    def add(self, words: list[str]) -> None:
        """Appends the lattices of ``words``: short words by plain products, the others by logarithms."""
        short = np.array([len(w) <= self.short for w in words])
        first = np.empty(len(words), np.int64)
        for part, plain in ((np.flatnonzero(short), True), (np.flatnonzero(~short), False)):
            if len(part):
                first[part] = self._add([words[i] for i in part.tolist()] if len(part) < len(words) else words, plain)
        self._append(first=first)

    def _add(self, words: list[str], plain: bool) -> np.ndarray:
        """Appends nodes and edges; returns the words' first nodes."""
        v = self.v
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lens, n = np.array([len(w) for w in words]), len(chars)
        stop = np.cumsum(lens)
        room = np.repeat(stop, lens) - np.arange(n)
        # every node has an edge of one character; longer ones follow in the order of their lengths
        node = v.step(np.zeros(n, np.int64), chars)
        one = np.where(node >= 0, v.final[node], -1)
        degree = np.ones(n, np.int64)
        src, rank, ids, size = [np.arange(n)], [np.zeros(n, np.int64)], [np.where(one >= 0, one, -1 - chars)], [np.ones(n, np.int64)]
        at = np.flatnonzero((node >= 0) & (room > 1))
        node, k = node[at], 1
        while len(at):
            node = v.step(node, chars[at + k])
            k += 1
            ok = node >= 0
            at, node = at[ok], node[ok]
            got = v.final[node]
            some = got >= 0
            here = at[some]
            src.append(here), rank.append(degree[here]), ids.append(got[some]), size.append(np.full(len(here), k))
            degree[here] += 1
            more = room[at] > k
            at, node = at[more], node[more]
        begin = np.cumsum(degree) - degree
        place = begin[np.concatenate(src)] + np.concatenate(rank)

        def placed(parts, dtype):
            out = np.empty(len(place), dtype)
            out[place] = np.concatenate(parts)
            return out

        ids, size = placed(ids, np.int32), placed(size, np.int32)
        src = np.repeat(np.arange(n), degree)
        q = (self._products if plain else self._logarithms)(begin, degree, src, ids, size, room)
        # in whole units of 2^-40, so that sums do not hang on the words before
        units = np.cumsum(np.rint(q * 2.0**40).astype(np.int64))
        cdf = (units - np.repeat(np.concatenate(([0], units))[begin], degree)) * 2.0**-40
        cdf[begin + degree - 1] = 2.0
        nodes, ends = len(self.begin), np.where(room[src] == size, 0, size)  # 0: the word ends
        self._append(begin=begin + len(self.ids), ids=ids, steps=ends, q=np.minimum(q, 1.0), cdf=cdf)
        return stop - lens + nodes

    def _rounds(self, begin: np.ndarray, degree: np.ndarray, room: np.ndarray):
        """Nodes by their distance to the word's end, their edges, and where each node's edges begin among them."""
        by = np.argsort(room.astype(np.uint16) if room.max() < 1 << 16 else room, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(room)[1:]))).tolist()
        for a, z in zip(cuts, cuts[1:]):  # noqa: B905
            if a < z:
                nodes = by[a:z]
                many = degree[nodes]
                head = np.cumsum(many) - many
                yield nodes, np.arange(int(many.sum())) + np.repeat(begin[nodes] - head, many), head, many

    def _products(self, begin, degree, src, ids, size, room) -> np.ndarray:
        """Conditional probability of each edge; a factor of e^2 per character keeps the products in range."""
        odds = np.where(ids >= 0, self.odds[ids], self.odds_unknown) * self.grow[size]
        z = np.ones(len(begin) + 1)
        reach = np.where(room[src] == size, len(begin), src + size)  # the last one: the word's end
        for nodes, e, head, _ in self._rounds(begin, degree, room):
            odds[e] = ways = odds[e] * z[reach[e]]
            z[nodes] = np.add.reduceat(ways, head)
        return odds / z[src]

    def _logarithms(self, begin, degree, src, ids, size, room) -> np.ndarray:
        total = self.alpha * np.where(ids >= 0, self.v.weight[ids], self.v.unknown)
        z = np.zeros(len(begin) + 1)
        reach = np.where(room[src] == size, len(begin), src + size)
        for nodes, e, head, many in self._rounds(begin, degree, room):
            total[e] = sums = total[e] + z[reach[e]]
            top = np.maximum.reduceat(sums, head)
            z[nodes] = top + np.log(np.add.reduceat(np.exp(sums - np.repeat(top, many)), head))
        return np.exp(total - z[src])

    def words(self, docs: list[list[str]]) -> np.ndarray:
        """Numbers of all words of ``docs``, adding those not met before."""
        if len(self.begin) > STORE_NODES:
            self.trim()
        index = self.index
        out = np.fromiter(map(index.__getitem__, chain.from_iterable(docs)), np.int64)
        if index.new:
            self.add(index.new)
            index.new = []
            if self.base is None and len(self.begin) > STORE_NODES // 3:
                self.base = len(index), {k: c.n for k, c in self.columns.items()}
        return out

    def trim(self) -> None:
        """Back to the words met first, which are the frequent ones, if they leave room."""
        if self.base is None or self.base[1]["begin"] > STORE_NODES // 2:
            return self.clear()
        words, stops = self.base
        kept = Index()
        kept.update(islice(self.index.items(), words))
        self.index = kept
        for k, n in stops.items():
            setattr(self, k, self.columns[k].cut(n))

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One sampled path from each node to its word's end: edges in path order, and how many each has."""
        who, at, edges, owner, places, count = np.arange(len(node)), node, [], [], [], np.zeros(len(node), np.int64)
        t = 0
        while len(who):
            u = uniform(key[who] + np.uint64(t))
            e = self.begin[at]
            late = np.flatnonzero(self.cdf[e] <= u)
            while len(late):
                e[late] += 1
                late = late[self.cdf[e[late]] <= u[late]]
            edges.append(e), owner.append(who), places.append(np.full(len(who), t))
            count[who] += 1
            step = self.steps[e]
            go = step > 0
            who, at, t = who[go], at[go] + step[go], t + 1
        base = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        if edges:
            out[base[np.concatenate(owner)] + np.concatenate(places)] = np.concatenate(edges)
        return out, count


    def tail(self, node: int, key: np.uint64) -> np.ndarray:
        """walk() from a single node."""
        out, draws = [], []
        begin, cdf, steps = self.begin, self.cdf, self.steps
        while True:
            t = len(out)
            if t == len(draws):
                draws += uniform(key + np.arange(t, t + 8, dtype=np.uint64)).tolist()
            e = int(begin[node])
            while cdf[e] <= draws[t]:
                e += 1
            out.append(e)
            step = int(steps[e])
            if not step:
                return np.array(out, np.int64)
            node += step


def uniform(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def truncated(phi: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at ``phi`` that do not exceed ``top``."""
    with np.errstate(over="ignore"):
        return np.minimum(phi - np.log(np.exp(phi - top) - np.log(np.maximum(u, 1e-300))), top)


def _regions(store: Store, keys: np.ndarray, sample: int, paths: list[np.ndarray], since: np.ndarray, top: np.ndarray, banned: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Perturbed scores of the regions that each path leaves behind from place ``since`` on, and the paths' log-probabilities.

    ``banned`` is the probability of the edges that are out at that place.
    """
    size = np.array([len(p) for p in paths])
    stop = np.cumsum(size)
    start = stop - size
    path = np.concatenate(paths)
    q = store.q[path]
    log = np.log(q)
    prefix = np.empty(len(path))
    for a, z in zip(start.tolist(), stop.tolist(), strict=True):  # by text, so that the sums are the same in any task
        np.cumsum(log[a:z], out=prefix[a:z])
    rest = 1.0 - q
    rest[start + since] -= banned
    cdf = store.cdf
    rest[(cdf[path] == 2.0) & ((path == 0) | (cdf[path - 1] == 2.0))] = 0.0  # a node's only edge
    place = np.arange(len(path)) - np.repeat(start, size)
    open_ = np.flatnonzero((rest > 1e-15) & (place >= np.repeat(since, size)))
    doc = np.repeat(np.arange(len(size)), size)[open_]
    phi = prefix[open_] - log[open_] + np.log(rest[open_])
    score = np.full(len(path), -np.inf)
    score[open_] = truncated(phi, top[doc], draws(keys[doc], sample, place[open_]))
    return np.split(score, stop[:-1]), prefix[stop - 1]


def draws(keys: np.ndarray, sample: int, place) -> np.ndarray:
    return uniform(keys ^ mix(np.atleast_1d(place).astype(np.uint64) + (np.uint64(sample) << np.uint64(40)) + np.uint64(1 << 62)))


def search(store: Store, docs: list[np.ndarray], keys: np.ndarray, k: int) -> tuple[list[list[tuple]], np.ndarray]:
    """The perturbed A-star search over the segmentations of each text, a row of words of ``docs`` (none empty).

    Up to k (path, log-probability, perturbed score) for each text, in the order of their scores, and the
    score of the next one. A round of all texts shares its array work; their frontiers are apart.
    """
    n = len(docs)
    with np.errstate(divide="ignore"):
        top = -np.log(-np.log(np.clip(draws(keys, k + 1, 0), 1e-300, 1 - 1e-16)))
    out: list[list[tuple]] = [[] for _ in docs]
    frontier: list[list[dict]] = [[] for _ in docs]
    paths, ends = _fresh(store, docs, keys, np.zeros(n, np.int64), 0)
    who, since, banned = np.arange(n), np.zeros(n, np.int64), [[] for _ in docs]
    bound = np.full(n, -np.inf)
    for sample in range(k + 1):
        scores, log_prob = _regions(store, keys[who], sample, paths, since, top, np.array([store.q[x].sum() if x else 0.0 for x in banned])) if len(who) else ([], [])
        for x, d in enumerate(who.tolist()):
            out[d].append((paths[x], float(log_prob[x]), float(top[x])))
            best = int(scores[x].argmax())
            frontier[d].append({"path": paths[x], "ends": ends[x], "score": scores[x], "at": best, "best": float(scores[x][best]), "since": int(since[x]), "banned": banned[x]})
        picked = [max(frontier[d], key=lambda r: r["best"]) for d in who.tolist()]
        bound[who] = [r["best"] for r in picked]
        if sample == k - 1:
            break
        alive = [x for x, r in enumerate(picked) if r["best"] > -np.inf]
        who, picked = who[alive], [picked[x] for x in alive]
        if not len(who):
            break
        top = bound[who]
        turn = draws(keys[who], sample + 1001, 0).tolist()
        tail_keys = mix(keys[who] + np.uint64(sample + 78))
        heads, since, banned, after = [], np.array([r["at"] for r in picked]), [], []
        for r, u, key in zip(picked, turn, tail_keys, strict=True):
            head, out_here = _turn(store, r, u, key)
            heads.append(head), banned.append(out_here)
            after.append(int(np.searchsorted(r["ends"], r["at"], side="right")) + 1)
            r["score"][r["at"]] = -np.inf
            r["at"] = int(r["score"].argmax())
            r["best"] = float(r["score"][r["at"]])
        rest, rest_ends = _fresh(store, [docs[d][a:] for d, a in zip(who.tolist(), after, strict=True)], keys[who], np.array(after), sample + 1)
        paths = [np.concatenate(x) for x in zip(heads, rest, strict=True)]
        ends = [np.concatenate((r["ends"][:a - 1], [len(h)], e + len(h))) for r, a, h, e in zip(picked, after, heads, rest_ends, strict=True)]
    return out, bound


def _fresh(store: Store, docs: list[np.ndarray], keys: np.ndarray, place: np.ndarray, sample: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sampled paths through the words of each text, and the places where its words end; ``place`` numbers the first word."""
    size = np.array([len(d) for d in docs])
    base = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(place - base, size)
    key = mix(np.repeat(keys, size) + mix(at.astype(np.uint64) + (np.uint64(sample) << np.uint64(48))))
    edges, count = store.walk(store.first[np.concatenate(docs)], key)
    ends = np.concatenate(([0], np.cumsum(count)))
    first, last = ends[base], ends[base + size]
    return [edges[a:z] for a, z in zip(first.tolist(), last.tolist(), strict=True)], [ends[b + 1:b + 1 + m] - a for b, m, a in zip(base.tolist(), size.tolist(), first.tolist(), strict=True)]


def _turn(store: Store, region: dict, u: float, key: np.uint64) -> tuple[np.ndarray, list[int]]:
    """The region's path up to its best place, another edge there and a sampled rest of the word; the edges that are out there."""
    path, j, cdf = region["path"], region["at"], store.cdf
    lo = hi = int(path[j])
    banned = [lo, *(region["banned"] if j == region["since"] else [])]
    while lo and cdf[lo - 1] != 2.0:
        lo -= 1
    while cdf[hi] != 2.0:
        hi += 1
    choice = [e for e in range(lo, hi + 1) if e not in banned]
    q = np.cumsum(store.q[choice])
    edge = choice[min(int(np.searchsorted(q, u * q[-1], side="right")), len(choice) - 1)]
    head = [path[:j], [edge]]
    if store.steps[edge]:
        node = int(np.searchsorted(store.begin, edge, side="right")) - 1 + int(store.steps[edge])
        head.append(store.tail(node, key))
    return np.concatenate(head), banned


_loaded: dict = {}


def segment(texts: list[str], keys: np.ndarray, store: Store, k: int, seed: int):
    """For each text: normalised text, and a list of (ids, log_prob, perturbed score, inclusion)."""
    v = store.v
    normal = v.sp.normalize(texts) if texts else []
    docs = [[n] if v.crossing and n else chunks(n) for n in normal]
    words = store.words(docs)
    size = np.array([len(d) for d in docs], np.int64)
    row = mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.array([seed], np.uint64)))
    some = np.flatnonzero(size)
    stop = np.cumsum(size)
    found, bound = search(store, [words[stop[i] - size[i]:stop[i]] for i in some.tolist()], row[some], k) if len(some) else ([], [])
    at = iter(zip(found, bound, strict=True))
    for i, text in enumerate(normal):
        if not size[i]:
            yield text, [([], 0.0, float("inf"), 1.0)]
            continue
        (paths, limit), out = next(at), []
        for path, log_prob, perturbed in paths:
            ids = v.spelled(store.ids[path])
            inclusion = 1.0 if np.isneginf(limit) else float(-np.expm1(-np.exp(min(700.0, log_prob - limit))))
            out.append((ids, log_prob, perturbed, inclusion))
        yield text, out


SCHEMA = "doc_id long, sample int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, inclusion double, decoded_bytes long, exact boolean"


def sampler(path: str | None, k: int, seed: int, alpha: float, with_ids: bool):
    def run(batches):
        if (path, alpha) not in _loaded:
            import public_tokenizers

            _loaded[path, alpha] = Store(Vocabulary(path or public_tokenizers.path("piece_bpe_32k.model")), alpha)
        store = _loaded[path, alpha]
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for i, j in slices(texts, SLICE):
                rows, each = [], []
                for x, (_, found) in zip(range(i, j), segment(texts[i:j], keys[i:j], store, k, seed), strict=True):
                    raw = texts[x].encode()
                    for s, (got, lp, g, inc) in enumerate(found):
                        back = store.v.decode(got.tolist() if len(got) else [])
                        rows.append((x, s, len(got), zlib.crc32(np.asarray(got, "<u4").tobytes()), lp, g, inc, len(back), back == raw))
                        each.append(got)
                cols = [ids.take(pa.array([r[0] for r in rows], pa.int64()))]
                cols += [pa.array([r[c] for r in rows], t) for c, t in zip(range(1, 9), (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()), strict=True)]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if with_ids:
                    cols.append(pa.array([list(map(int, g)) for g in each], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, alpha: float = ALPHA, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """Up to k distinct segmentations of each text, the greatest perturbed score first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sampler(model, k, seed, alpha, with_ids), SCHEMA + ", ids array<int>" * with_ids)
