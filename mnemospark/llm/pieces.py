"""SentencePiece sampling: distinct segmentations by Gumbel top-k without replacement.

The pieces of a SentencePiece model span a lattice over a text: every path from its begin
to its end is a segmentation. A piece has the log-probability of a Zipf distribution over
the ranks of the model's scores (characters without a piece: their bytes, at the last rank),
and paths their normalised products. Perturbed A-star search emits the ``k`` paths with
the largest log-probability plus Gumbel noise, in order, which is sampling without
replacement; the inclusion score of a path is the log-probability that its noise would
have placed it above the (k+1)-th.

Pieces never cross from one word to the next, so the lattice is a chain of small ones.
The branches of a step are weighed by sums over all continuations, which a worker works
out once for each word. A node of the search stands for all paths that leave an emitted
path at one step: its log-probability is that of the prefix times what the step did not
choose, and its noise is Gumbel truncated by its parent's, drawn for all steps of a path
at once. Popping a node chooses among the step's other branches; the steps after it are
drawn for all texts of a block together.

Defined cases: a null text is an empty one; an empty text has one empty segmentation with
the score 0; a text with fewer than ``k`` segmentations gives them all, with scores 0; rows
with equal keys and texts get equal samples; "\\u2581" in a text is read as a space, as
the model does; rows with a null id are sampled by their text; very long texts are one
lattice, searched whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import blocks, give_back, segments, tune, worker_cache

SPACE = "▁"
#: Parts of a text that no piece crosses: a run of letters or of others after its spaces. The
#: coarser form is for models with pieces that mix them.
_FINE = re.compile(rf"{SPACE}*[^\W\d_²³¹]+|{SPACE}*(?:[^\w{SPACE}\n]|[\d_²³¹])+|{SPACE}+|\n")
_COARSE = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: Bytes of words and branches that a worker remembers; it starts anew beyond them.
REMEMBERED = 96 << 20
#: Characters of new words whose lattices are worked out at a time; a longer word is worked out whole.
LEARNED = 1 << 15
#: What a remembered word takes beside its characters: its entry in a dict, and the string.
_ENTRY = 170
#: Where a path has become this unlikely, leaving it cannot matter: the chance is below e ** -60.
_FAINT = -100.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(stream: np.ndarray, index: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1), each a function of its stream and index alone."""
    steps = np.atleast_1d(np.asarray(index)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((_mixed(stream + steps) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def _strings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the strings end to end, and the length of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.fromiter(map(len, texts), np.int64, len(texts))


def _longer(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The hashes of strings with one more character."""
    return _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + points.astype(np.uint64) + np.uint64(1))


def _hashed(texts: list[str]) -> np.ndarray:
    """The hash of each string, all worked out a character at a time."""
    points, lengths = _strings(texts)
    starts, out = np.cumsum(lengths) - lengths, np.zeros(len(texts), np.uint64)
    for n in range(int(lengths.max(initial=0))):
        own = np.flatnonzero(lengths > n)
        out[own] = _longer(out[own], points[starts[own] + n])
    return out


class Lattices:
    """Steps of all words met so far, in flat arrays.

    A step is a position in a word, the rest of which is still to be cut. Step s has the
    branches ``first[s] : first[s] + size[s]``, one for each piece that may come next, the
    longest first: its ids (``n`` of them from ``at`` on), the running sum ``cum`` of
    probabilities plus s, its log-probability ``logp`` and the step that follows, -1 at the
    end of the word. Probabilities take all continuations into account. The lattices of all new
    words of a block are worked out together, from the words' ends to their beginnings.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        usable = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        ranked = sorted(usable, key=lambda i: (-sp.get_score(i), i))
        total = math.log(sum(1 / (r + 2) for r in range(len(ranked) + 1)))
        self.pieces = {names[i]: (i, -math.log(r + 2) - total) for r, i in enumerate(ranked)}
        self.cut = (_FINE if all(map(_FINE.fullmatch, self.pieces)) else _COARSE).findall
        self.longest = max(map(len, self.pieces), default=1)
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_logp = -math.log(len(ranked) + 2) - total
        self.fixed = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.lengths = np.array(list(map(len, self.fixed)), np.int32)
        self.spelling, self.begins = np.frombuffer(b"".join(self.fixed), np.uint8), np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        # all beginnings of pieces by their hashes, with the piece that ends there or -1
        begun = sorted({p[:j] for p in self.pieces for j in range(1, len(p) + 1)})
        hashes = _hashed(begun)
        order = np.argsort(hashes)
        self.begun = hashes[order]
        if len(begun) > 1 and (self.begun[1:] == self.begun[:-1]).any():
            raise ValueError("two beginnings of pieces share a hash")
        # where to begin in them: the first whose upper bits are not smaller
        self.slots = np.searchsorted(self.begun, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
        self.ending = np.array([self.pieces.get(p, (-1,))[0] for p in begun], np.int64)[order]
        self.piece_logp = np.zeros(n)
        for i, logp in self.pieces.values():
            self.piece_logp[i] = logp
        self.reset()

    def reset(self) -> None:
        self.steps: dict[str, int] = {}
        kinds = {"first": np.int32, "size": np.int32, "cum": np.float64, "logp": np.float64, "next": np.int32, "at": np.int32, "n": np.int8, "ids": np.int32}
        self.used: dict[str, int] = dict.fromkeys(kinds, 0)
        self.kept = {name: np.zeros(1 << 12, kind) for name, kind in kinds.items()}
        self.word_bytes = 0

    def nbytes(self) -> int:
        return self.word_bytes + sum(x.nbytes for x in self.kept.values())

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among those of the beginnings of pieces, or of its successor there."""
        last = len(self.begun) - 1
        found = np.minimum(self.slots[hashes >> np.uint64(48)], last)
        open_ = np.flatnonzero(self.begun[found] < hashes)
        while len(open_):
            open_ = open_[found[open_] < last]
            found[open_] += 1
            open_ = open_[self.begun[found[open_]] < hashes[open_]]
        return found

    def _edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, piece) of all pieces in the words; ``ends`` has the end of each position's word."""
        alive, hashes = np.arange(len(points)), np.zeros(len(points), np.uint64)
        source, length, piece = [], [], []
        for n in range(1, self.longest + 1):
            inside = alive + n <= ends[alive]
            alive, hashes = alive[inside], hashes[inside]
            if not len(alive):
                break
            hashes = _longer(hashes, points[alive + n - 1])
            found = self._place(hashes)
            known = self.begun[found] == hashes
            alive, hashes, found = alive[known], hashes[known], self.ending[found[known]]
            whole = found >= 0
            source.append(alive[whole])
            length.append(np.full(int(whole.sum()), n))
            piece.append(found[whole])
        single = np.zeros(len(points), bool)
        if source:
            single[source[0]] = True
        missing = np.flatnonzero(~single)  # characters without a piece: their bytes
        source, length, piece = (np.concatenate([*x, y]) for x, y in ((source, missing), (length, np.ones(len(missing), np.int64)), (piece, np.full(len(missing), -1))))
        order = np.argsort(source * (self.longest + 2) - length)
        return source[order], length[order], piece[order]

    def learn(self, new: list[str]) -> None:
        """Work out the lattices of words not met before."""
        points, lengths = _strings(new)
        total = len(points)
        word_ends = np.cumsum(lengths)
        ends = np.repeat(word_ends, lengths)
        source, length, piece = self._edges(points, ends)
        target = source + length
        n = np.ones(len(source), np.int64)
        logp = self.piece_logp[piece]
        raw = {int(e): chr(int(points[source[e]])).encode("utf-8", "surrogatepass") for e in np.flatnonzero(piece < 0)}
        for e, own in raw.items():
            n[e], logp[e] = len(own), len(own) * self.byte_logp
        size = np.bincount(source, minlength=total)
        first = np.cumsum(size) - size
        # sums over all ways to finish a word, from its end on
        beta, value = np.zeros(total + 1), np.zeros(len(source))
        left = ends - np.arange(total)
        by = np.argsort(left, kind="stable")
        cuts = np.searchsorted(left[by], np.arange(1, int(left.max()) + 2))
        for d in range(len(cuts) - 1):
            own = by[cuts[d] : cuts[d + 1]]
            run, place = segments(size[own])
            e = first[own][run] + place
            done = target[e] == ends[own][run]
            value[e] = logp[e] + np.where(done, 0.0, beta[target[e]])
            heads = np.cumsum(size[own]) - size[own]
            most = np.maximum.reduceat(value[e], heads)
            beta[own] = most + np.log(np.add.reduceat(np.exp(value[e] - most[run]), heads))
        logp = np.minimum(value - beta[source], 0.0)
        base, used = self.used["first"], self.used["cum"]
        sums = np.append(0.0, np.cumsum(np.exp(logp)))
        cum = np.minimum(sums[1:] - sums[first[source]], 1.0) + (base + source)
        cum[first + size - 1] = base + np.arange(total) + 1.0
        ids_end = np.cumsum(n)
        ids = np.zeros(int(ids_end[-1]), np.int32)
        ids[ids_end - n] = piece
        for e, own in raw.items():
            ids[ids_end[e] - n[e] : ids_end[e]] = [self.byte_ids[b] for b in own]
        rows = {
            "first": first + used, "size": size, "cum": cum, "logp": logp, "next": np.where(target == ends[source], -1, target + base),
            "at": ids_end - n + self.used["ids"], "n": n, "ids": ids,
        }
        for name, values in rows.items():
            at, to = self.used[name], self.used[name] + len(values)
            if to > len(self.kept[name]):
                more = np.zeros(max(to, len(self.kept[name]) * 3 // 2) - len(self.kept[name]), self.kept[name].dtype)
                self.kept[name] = np.concatenate([self.kept[name], more])
            self.kept[name][at:to] = values
            self.used[name] = to
        self.steps.update(zip(new, (base + word_ends - lengths).tolist()))
        self.word_bytes += _ENTRY * len(new) + 2 * total

    def units(self, text: str) -> list[str]:
        """The text with spaces as the model writes them, cut where no piece crosses."""
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def codes(self, units: list[str]) -> np.ndarray:
        """The first step of each word."""
        new = [w for w in dict.fromkeys(units) if w not in self.steps]
        new.sort(key=len)  # a slice at a time, words of like length together
        ends, at = np.cumsum(np.fromiter(map(len, new), np.int64, len(new))), 0
        while at < len(new):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + LEARNED, "right")))
            self.learn(new[at:to])
            at = to
        for name in self.kept:
            setattr(self, name, self.kept[name][: self.used[name]])
        return np.fromiter(map(self.steps.__getitem__, units), np.int64, len(units))

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of the pieces end to end."""
        out = []
        for a in range(0, len(ids), 1 << 17):
            own = ids[a : a + (1 << 17)]
            n = self.lengths[own]
            at = np.repeat(self.begins[own] - np.cumsum(n, dtype=np.int32) + n, n)
            at += np.arange(len(at), dtype=np.int32)
            out.append(self.spelling[at].tobytes())
        return b"".join(out)

    def draw(self, first_steps: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path from each of the given steps: the branches of all end to end, and how many each has."""
        steps, of, depth = first_steps, np.arange(len(first_steps)), 0
        counts, found = np.ones(len(first_steps), np.int64), []
        while len(steps):
            branch, aim = self.first[steps], steps + _uniform(streams, depth)
            open_ = np.flatnonzero(aim >= self.cum[branch])
            while len(open_):
                branch[open_] += 1
                open_ = open_[aim[open_] >= self.cum[branch[open_]]]
            found.append((branch, of))
            following = self.next[branch]
            more = np.flatnonzero(following >= 0)
            steps, of, streams, depth = following[more], of[more], streams[more], depth + 1
            counts[of] += 1
        starts = np.cumsum(counts) - counts
        branches = np.empty(int(counts.sum()), np.int64)
        for level, (branch, at) in enumerate(found):
            branches[starts[at] + level] = branch
        return branches, counts

    def step_of(self, branches: np.ndarray) -> np.ndarray:
        return np.ceil(self.cum[branches]).astype(np.int64) - 1


def _number(key: int, i: int) -> float:
    """``_uniform(_mixed(key + i), 0)`` of one number."""
    x = (key + i) & (2**64 - 1)
    for _ in range(2):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        x ^= x >> 31
    return ((x >> 12) + 0.5) / float(1 << 52)


class _Search:
    """The search over one text: emitted paths, and the ways to leave them by falling noise."""

    def __init__(self, lattices: Lattices, codes: np.ndarray, key: int) -> None:
        self.lattices, self.codes, self.key = lattices, codes, key & (2**64 - 1)
        #: Of each path its branches, the words of those before its drawn tail, the tail's first word and the branches of each word there.
        self.paths: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []
        self.heap: list = []
        empty = np.empty(0, np.int64)
        # the first path has the noise of all of them together
        self.start = (empty, empty, -math.log(-math.log(_number(self.key, 1))), [], 0)
        self.tail, self.base = codes, 0

    def next_tail(self) -> bool:
        """Choose the next path's branch where it leaves an emitted one; what follows is to be drawn."""
        if not self.heap:
            return False
        noise, at, own, banned = heapq.heappop(self.heap)
        branches, before_of, base, counts = self.paths[at]
        of = np.append(before_of, np.repeat(np.arange(min(len(counts), own + 1)) + base, counts[: own + 1]))[: own + 1]
        lattices = self.lattices
        s = int(lattices.step_of(branches[own]))
        options = [b for b in range(int(lattices.first[s]), int(lattices.first[s] + lattices.size[s])) if b not in banned]
        weight = np.exp(lattices.logp[options])
        u = _number(self.key, 2 * len(self.paths) + 4)
        pick = options[min(int(np.searchsorted(np.cumsum(weight) / weight.sum(), u, "right")), len(options) - 1)]
        follow, word = int(lattices.next[pick]), int(of[own])
        self.start = (np.append(branches[:own], pick), of, -noise, banned, own)
        self.base = word if follow >= 0 else word + 1
        self.tail = np.append(follow, self.codes[word + 1 :]) if follow >= 0 else self.codes[word + 1 :]
        return True


def _emit(lattices: Lattices, searches: list[_Search], branches: np.ndarray, counts: np.ndarray, sizes: np.ndarray, k: int) -> None:
    """Each search takes the path that ends with its drawn tail, and gets the ways to leave it."""
    word_ends = np.cumsum(sizes)
    ends = np.append(0, np.cumsum(counts))[np.append(0, word_ends)]
    paths = [branches[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    if len(searches[0].paths):
        paths = [np.concatenate([x.start[0], own]) for x, own in zip(searches, paths)]
        branches = np.concatenate(paths)
    for x, own, a, b in zip(searches, paths, (word_ends - sizes).tolist(), word_ends.tolist()):
        x.paths.append((own, x.start[1], x.base, counts[a:b]))
    lengths = np.fromiter(map(len, paths), np.int64, len(paths))
    starts = np.cumsum(lengths) - lengths
    logp = lattices.logp[branches]
    before = np.empty_like(logp)
    for a, b in zip(starts.tolist(), (starts + lengths).tolist()):  # apart, so that rounding does not depend on the other texts
        np.cumsum(logp[a:b], out=before[a:b])
    before -= logp
    likely = np.append(0, np.cumsum(before >= _FAINT))
    since = np.fromiter((x.start[4] for x in searches), np.int64, len(searches))
    width = np.maximum(np.minimum(lengths, np.maximum(likely[starts + lengths] - likely[starts] + 1, since + 64)) - since, 0)
    of, place = segments(width)
    at = (starts + since)[of] + place
    rest, left = -np.expm1(logp[at]), lattices.size[lattices.step_of(branches[at])] - 1  # what the steps did not choose
    heads = np.cumsum(width) - width
    for x, head, n in zip(searches, heads.tolist(), width.tolist()):
        if n and x.start[3]:
            rest[head] -= np.exp(lattices.logp[np.array(x.start[3])]).sum()
            left[head] -= len(x.start[3])
    phi = before[at] + np.log(np.maximum(rest, 1e-300))
    phi[left <= 0] = -np.inf
    keys = np.array([x.key for x in searches], np.uint64) + np.uint64(2 * len(searches[0].paths) + 1)
    bound = np.array([x.start[2] for x in searches])
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        noise = phi - np.log(np.exp(phi - bound[of]) - np.log(_uniform(_mixed(keys)[of], place)))
    noise[np.isneginf(phi)] = -np.inf
    for x, own, head, n in zip(searches, paths, heads.tolist(), width.tolist()):
        found = noise[head : head + n]
        best = np.argpartition(-found, k)[: k + 1].tolist() if n > k + 1 else range(n)
        _, _, _, banned, first = x.start
        for j in best:
            value = float(found[j])
            if value > -np.inf:
                heapq.heappush(x.heap, (-value, len(x.paths) - 1, first + j, [*(() if j else banned), int(own[first + j])]))


def _results(lattices: Lattices, searches: list[_Search]) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each search (ids, log-probability, log-probability of inclusion) of its paths."""
    paths = [path[0] for x in searches for path in x.paths]
    if not paths:
        return [[] for _ in searches]
    branches = np.concatenate(paths)
    n = lattices.n[branches].astype(np.int64)
    run, place = segments(n)
    ids = lattices.ids[lattices.at[branches][run] + place]
    id_ends = np.append(0, np.cumsum(n))
    logp, out, at, a = lattices.logp[branches], [], 0, 0
    for x in searches:
        limit = -x.heap[0][0] if x.heap else -np.inf  # the noise of the path after the last
        own = []
        for path in x.paths:
            b = a + len(path[0])
            total = float(logp[a:b].sum())
            to = int(id_ends[b])
            own.append((ids[at:to], total, 0.0 if limit == -np.inf else _log_included(total - limit)))
            a, at = b, to
        out.append(own)
    return out


def sample(lattices: Lattices, texts: list[np.ndarray], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text (the first steps of its words) at most ``k`` distinct segmentations by falling perturbed log-probability."""
    searches = [_Search(lattices, codes, key) for codes, key in zip(texts, keys)]
    active = searches
    for turn in range(k):
        if turn:
            active = [x for x in active if x.next_tail()]
        if not active:
            break
        sizes = np.array([len(x.tail) for x in active], np.int64)
        of, place = segments(sizes)
        own_keys = _mixed(np.array([x.key for x in active], np.uint64) + np.uint64((turn + 1) << 40))
        streams = _mixed(own_keys[of] + (place + np.array([x.base for x in active])[of]).astype(np.uint64))
        branches, counts = lattices.draw(np.concatenate([x.tail for x in active]), streams)
        _emit(lattices, active, branches, counts, sizes, k)
    return _results(lattices, searches)


def _log_included(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 3:
        return math.log1p(-math.exp(-math.exp(min(x, 6))))
    if x < -30:
        return x
    return math.log(-math.expm1(-math.exp(x)))


def lattices_of(model: str) -> Lattices:
    known = worker_cache("lattices")
    if model not in known:
        known[model] = Lattices(model)
    if known[model].nbytes() > REMEMBERED:
        known[model].reset()
    return known[model]


def decode(lattices: Lattices, ids: np.ndarray) -> str:
    """The text of a segmentation, without the space the model puts before it."""
    raw = lattices.spell(ids)
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def faithful(lattices: Lattices, texts: list[str], paths: list[list[np.ndarray]]) -> list[bool]:
    """For each path of each text, one after another: whether it decodes to the text. All are spelled together."""
    every = [ids for own in paths for ids in own]
    if not every:
        return []
    ids = np.concatenate(every)
    raw = lattices.spell(ids)
    ends = np.append(0, np.cumsum(lattices.lengths[ids], dtype=np.int64))[np.cumsum([0, *map(len, every)])].tolist()
    out, at = [], 0
    for x, own in zip(texts, paths):
        want = x.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for _ in own:
            a, b = ends[at], ends[at + 1]
            out.append(raw[a + (raw[a : min(a + 1, b)] == b" ") : b] == want)
            at += 1
    return out


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, rank, ids, log_prob, inclusion, decoded_ok``: up to ``k`` rows for each row of ``docs``.

    ``inclusion`` is the log-probability of inclusion; ``decoded_ok`` that decoding the ids
    gives the text back. The random numbers of a row depend on ``seed``, id and text alone.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"))
    columns = ["doc_id", "rank", "ids", "log_prob", "inclusion", "decoded_ok"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 20):
            lattices = lattices_of(model)
            texts = [x or "" for x in block.column("text").to_pylist()]
            split = [lattices.units(x) for x in texts]
            codes = lattices.codes(list(chain.from_iterable(split)))
            ends = np.cumsum([len(x) for x in split])
            keys = [(x ^ (seed * 0x9E3779B97F4A7C15)) & (2**64 - 1) for x in block.column("key").to_pylist()]
            found = sample(lattices, np.split(codes, ends[:-1]), keys, k)
            ids, rank, lists, logp, chance = [], [], [], [], []
            for doc, own in zip(block.column("doc_id").to_pylist(), found):
                for r, (pieces, lp, inc) in enumerate(own):
                    ids.append(doc)
                    rank.append(r)
                    lists.append(pieces)
                    logp.append(lp)
                    chance.append(inc)
            same = faithful(lattices, texts, [[x[0] for x in own] for own in found])
            at = np.append(0, np.cumsum([len(x) for x in lists]))
            values = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rank, pa.int32()), values, pa.array(logp, pa.float64()), pa.array(chance, pa.float64()), pa.array(same, pa.bool_())], columns)
        give_back()

    return rows.mapInArrow(cut, "doc_id long, rank int, ids array<int>, log_prob double, inclusion double, decoded_ok boolean")
