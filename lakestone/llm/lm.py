"""Language-model scoring with a weighted backoff automaton.

The model interpolates n-gram estimates of order 1 to n:

    P1(w) = (c(w) + 1) / (N + V + 1)
    Pk(w | h) = weight * c(h w) / c(h) + (1 - weight) * Pk-1(w | h')    for contexts seen in training
    Pk(w | h) = Pk-1(w | h')                                            for others

with h' the context without its first word, so every Pk sums to one over the vocabulary
and one unknown word.  As an automaton the states are the seen contexts.  A state's arc for a
seen n-gram carries the whole log Pk and leads to the longest context of the new history; its
failure arc carries log(1 - weight) to the state of h'; the unigram state has an arc for every
word.  Texts are read from left to right, all of a block side by side: each carries its
state, follows failure arcs down to a state with an arc for the token, and adds up the
weights met.

Counts are taken over all training texts.  A block of documents asks the corpus for the
counts of its own n-grams (``blocks``), so it holds just the part of the automaton that its
texts can reach, and the rest of the model never leaves the key ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .textops import TOKEN_BYTES, U64, Words, mix, pieces

#: Hashes of the end token and of what stands before a text's first token.
END, START = U64(0x8A5CD789635D2DFF), U64(0x121FD2155C472F96)
_STEP = U64(0xD6E8FEB86659FD93)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end token, and the first token of each text."""
    hashes, firsts, base = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in pieces(texts):
        w = Words(data, offsets, TOKEN_BYTES)
        ends = w.first[1:]
        hashes.append(np.insert(w.hash, ends, END))
        firsts.append(base + ends + np.arange(1, len(ends) + 1))
        base += len(hashes[-1])
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate(firsts)


def _ngrams(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams that end at each token, for n = 1 to ``order``; before a text stand START words."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    out, acc = [tokens], tokens.copy()
    with np.errstate(over="ignore"):
        for back in range(1, order):
            before = np.full(len(tokens), START, U64)
            before[back:] = np.where(place[back:] >= back, tokens[:-back], START)
            acc = acc * _STEP + before * U64(2 * back + 1)
            out.append(mix(acc))
    return out


def _contexts(grams: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """For n = 2 to order, the key of the (n-1)-gram before each token; at a text's start the START context."""
    starts = np.zeros(len(grams[0]), bool)
    starts[first[:-1][np.diff(first) > 0]] = True
    out = []
    for g in grams[:-1]:
        before = np.empty_like(g)
        before[1:] = g[:-1]
        before[starts] = START
        out.append(before)
    return out


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    """Rows kept out of training; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


_KINDS = "<u8"


def _emit(order: int, ranges: int):
    """A block's n-grams and, for each, how often its training texts have it."""
    def run(table: pa.Table) -> pa.Table:
        tokens, first = _tokens(table["text"])
        train = np.repeat(~table["held_out"].to_numpy(), np.diff(first))
        levels = []
        for n, keys in enumerate(_ngrams(tokens, first, order), 1):
            distinct, at = np.unique(keys, return_inverse=True)
            levels.append((n, distinct, np.bincount(at, weights=train, minlength=len(distinct)).astype(_KINDS)))
        return blocks.send(table["_block"][0].as_py(), ranges, levels)
    return run


def _total(level: int, keys: np.ndarray, where: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    counts = np.zeros(len(keys), _KINDS)
    for at, v in zip(where, values, strict=True):
        counts[at] += v
    return [counts[at] for at in where]


#: Tokens of a text that are walked in a row; a longer text is walked in several places at once.
STRIDE = 1024


class Automaton:
    """The states and arcs that a block's texts can reach, from the counts of its n-grams.

    State 0 is that of unigrams.  ``fail`` holds each state's failure target, ``arcs`` the ascending
    codes (state, word) of all arcs, ``weights`` and ``targets`` what they carry and where they lead.
    """

    def __init__(self, tokens: np.ndarray, first: np.ndarray, counts: list[np.ndarray], size: int, train_texts: int,
                 weight: float = 0.5):
        order = len(counts)
        self.order, self.down = order, float(np.log10(1 - weight))
        self.words, self.word = np.unique(tokens, return_inverse=True)
        grams = _ngrams(tokens, first, order)
        count = [c[np.unique(g, return_inverse=True)[1]].astype(np.float64) for g, c in zip(grams, counts, strict=True)]
        # Per level the state of each token's context, and how often training has the context.
        states, fails = [np.zeros(len(tokens), np.int64)], [np.zeros(1, np.int64)]
        seen = [np.full(len(tokens), float(size))]
        keys: list[np.ndarray] = [np.zeros(0, U64)]
        total = 1
        for level, before in enumerate(_contexts(grams, first), 1):
            often = np.empty(len(tokens))
            often[1:] = count[level - 1][:-1]
            often[before == START] = train_texts
            real = np.flatnonzero(often > 0)
            known, at, place = np.unique(before[real], return_index=True, return_inverse=True)
            state = np.full(len(tokens), -1)
            state[real] = total + place
            fails.append(states[-1][real[at]])
            states.append(state)
            seen.append(often)
            keys.append(known)
            total += len(known)
        self.fail = np.concatenate(fails)
        self.start = int(total - len(keys[-1]) + np.searchsorted(keys[-1], START)) if order > 1 and train_texts and len(tokens) else 0
        base = np.cumsum([1, *[len(k) for k in keys[1:]]])
        codes, weights, targets = [], [], []
        p = (count[0] + 1) / size
        for level in range(order):
            if level:
                inside = states[level] >= 0
                ratio = np.divide(count[level], seen[level], out=np.zeros(len(tokens)), where=inside)
                p = np.where(inside, weight * ratio + (1 - weight) * p, p)
            at = np.flatnonzero((states[level] >= 0) & ((count[level] > 0) | (level == 0)))
            code, one = np.unique(states[level][at] * len(self.words) + self.word[at], return_index=True)
            at = at[one]
            # After the n-gram the history is known to its last words: the longest context that can be a state.
            longest = min(level + 1, order - 1)
            target = np.zeros(len(at), np.int64)
            if longest and len(keys[longest]):
                place = np.minimum(np.searchsorted(keys[longest], grams[longest - 1][at]), len(keys[longest]) - 1)
                target = np.where(keys[longest][place] == grams[longest - 1][at], base[longest - 1] + place, 0)
            codes.append(code)
            weights.append(np.log10(p[at]))
            targets.append(target)
        by = np.argsort(np.concatenate(codes), kind="stable")
        self.arcs, self.weights, self.targets = (np.concatenate(x)[by] for x in (codes, weights, targets))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state reached, weights met) of walkers that read one word each."""
        state, met = state.copy(), np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            code = state[todo] * len(self.words) + word[todo]
            at = np.minimum(np.searchsorted(self.arcs, code), len(self.arcs) - 1)
            there = self.arcs[at] == code
            met[todo[there]] += self.weights[at[there]]
            state[todo[there]] = self.targets[at[there]]
            todo = todo[~there]
            met[todo] += self.down
            state[todo] = self.fail[state[todo]]
        return state, met

    def run(self, first: np.ndarray) -> np.ndarray:
        """log10 P of each token of the block.

        A walker reads ``STRIDE`` tokens.  One that begins inside a text reads the words of a
        context before, from the unigram state: that alone decides its state.
        """
        out = np.zeros(first[-1])
        size = np.diff(first)
        pieces_of = -(-size // STRIDE)
        text = np.repeat(np.arange(len(size)), pieces_of)
        begin = first[:-1][text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of))
        end = np.minimum(begin + STRIDE, first[1:][text])
        at = np.maximum(begin - (self.order - 1), first[:-1][text])
        state = np.where(at == first[:-1][text], self.start, 0)
        by = np.argsort(at - end, kind="stable")  # the longest first, so walkers end from the back
        begin, end, at, state = begin[by], end[by], at[by], state[by]
        live = len(at)
        while live:
            state[:live], met = self.step(state[:live], self.word[at[:live]])
            own = at[:live] >= begin[:live]
            out[at[:live][own]] = met[own]
            at[:live] += 1
            live = int(np.searchsorted(at[:live] - end[:live], 0))
        return out


_SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
           "score double")


def _score(order: int, weight: float, n: int, v: int, texts: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        counts = blocks.joined(answers, dict.fromkeys(range(1, order + 1), _KINDS))
        tokens, first = _tokens(docs["text"])
        machine = Automaton(tokens, first, [counts[k] for k in range(1, order + 1)], n + v + 1, texts, weight)
        c = counts[1][machine.word].astype(np.float64)
        base = np.log10((c + 1) / (n + v + 1))

        def per_text(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)

        return pa.table([docs["doc_id"], docs["held_out"], pa.array(np.diff(first), pa.int64()),
                         pa.array(per_text((c > 0).astype(np.int64)).astype(np.int64)), pa.array(np.full(len(docs), n)),
                         pa.array(per_text(base)), pa.array(per_text(machine.run(first)))],
                        names=[f.split()[0] for f in _SCORES.split(", ")])
    return run


def score(docs: DataFrame, order: int = 2, weight: float = 0.5, block_chars: int = blocks.BLOCK_CHARS,
          modulus: int = 7, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Trains on the rows that are not held out and scores all, whole.  Null texts are empty:
    they have the end token only.  Repeated rows count and are scored each.  With no
    training text all counts are 0 and every token has probability 1 / 1 of the unknown
    word; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    dealt, ranges = blocks.dealt(rows, block_chars)
    n, v, texts = _training_size(rows, ranges)
    sent = dealt.groupBy("_block").applyInArrow(_emit(order, ranges), blocks.SENT)
    answers = blocks.answered(sent, _total, _KINDS)
    return (dealt.groupBy("_block").cogroup(answers.groupBy("block"))
            .applyInArrow(_score(order, weight, n, v, texts), _SCORES))


def _training_size(rows: DataFrame, ranges: int) -> tuple[int, int, int]:
    """Tokens, distinct tokens and texts of training, exactly; three numbers reach the driver."""
    def words(batches):
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                hashes, first = _tokens(part.column(0))
                if len(hashes):
                    distinct, counts = np.unique(hashes, return_counts=True)
                    table = blocks.send(0, ranges, [(1, distinct, counts.astype(np.int64))])
                    yield from table.to_batches()

    train = rows.filter(~F.col("held_out")).select("text")
    sent = train.mapInArrow(words, blocks.SENT)

    def measure(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([blocks.unpack_keys(x) for x in table["keys"].to_pylist()]))
        total = sum(int(blocks.from_planes(x, np.int64).sum()) for x in table["values"].to_pylist())
        return pa.table({"tokens": [total], "distinct": [len(keys)]})

    x = (sent.select("range", "keys", "values").groupBy("range").applyInArrow(measure, "tokens long, distinct long")
         .agg(F.sum("tokens"), F.sum("distinct")).first())
    return int(x[0] or 0), int(x[1] or 0), train.count()
