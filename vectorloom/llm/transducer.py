"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic machines run one after the other.

**Pre-token machine.** Its states say which run (letters, numbers, marks, white space, a
contraction) the text is in; its alphabet is the class of a character together with what the
pre-tokenizer's look-ahead needs to know of the next ones. A transition emits 1 where a new
pre-token begins. A batch of texts is cut into chunks of equal size. All chunks are run at
once from every state, which gives each chunk's state map with the number of pre-tokens it
emits; a parallel prefix scan composes the maps, so that the true entry state of each chunk
is known, and a last run from there marks the boundaries.

**Merge machine.** It reads the bytes of a pre-token. The encoding of a prefix ends in exactly
one token, namely the one that can follow the encoding of what stands before it, and two
tokens can stand side by side when the pair encodes to itself. So the state after a byte needs
only the longest suffix that may still grow into a token, and, for each place in it where such
a token may begin, the token that ends there and how many tokens fewer there are up to it.
That is finite. A transition is annotated with the change of the token count, so the weights
along a pre-token add up to its count. Transitions are compiled when first met, as lazy regular
expression automata do, and the machine starts anew when it has ``MAX_STATES``; counts are
the same at any size. All pre-tokens of a batch run side by side.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a special string in a text is one
token, as the library has it by default; repeated rows are counted each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.tokens import byte_letters
from vectorloom.llm.worker import kept

# --- pre-token machine ------------------------------------------------------------------

LETTER, NUMBER, MARK, SPACE = range(4)
# Symbols: class and look-ahead. IN: more white space or the end follows; LAST: neither.
SYM_LETTER, SYM_NUMBER, SYM_MARK, SYM_SHORT, SYM_LONG, BLANK_IN, BLANK_LAST, SPACE_IN, SPACE_LAST = range(9)
SYMBOLS = 9
(START, LETTERS, NUMBERS, MARKS, SPACES, BLANK, LONE, TWO_LEFT, ONE_LEFT, DONE) = range(10)
STATES = 10
#: Symbols from this value on are the first of a text; the last one pads and changes nothing.
FIRST = SYMBOLS
PAD = 2 * SYMBOLS

#: Characters per chunk of the scan.
CHUNK = 512
#: Characters handled at once, and per part of a longer text.
BATCH_CHARS = 1 << 18


def pre_token_tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted pre-tokens) by ``symbol * STATES + state``."""
    after = np.zeros((2 * SYMBOLS + 1, STATES), np.uint8)
    emits = np.zeros((2 * SYMBOLS + 1, STATES), np.uint8)
    runs = {
        SYM_LETTER: (LETTERS, (LETTERS, BLANK)),
        SYM_NUMBER: (NUMBERS, (NUMBERS, BLANK)),
        SYM_MARK: (MARKS, (MARKS, BLANK)),
        BLANK_IN: (SPACES, (SPACES,)),
        SPACE_IN: (SPACES, (SPACES,)),
        BLANK_LAST: (BLANK, ()),
        SPACE_LAST: (LONE, ()),
        SYM_SHORT: (ONE_LEFT, ()),
        SYM_LONG: (TWO_LEFT, ()),
    }
    for symbol, (into, going_on) in runs.items():
        for state in range(STATES):
            after[symbol, state] = into
            emits[symbol, state] = state not in going_on
    for symbol in (SYM_SHORT, SYM_LONG):  # inside a run of marks an apostrophe is a mark
        for state in (MARKS, BLANK):
            after[symbol, state], emits[symbol, state] = MARKS, 0
    for state, into in ((TWO_LEFT, ONE_LEFT), (ONE_LEFT, DONE)):
        after[SYM_LETTER, state], emits[SYM_LETTER, state] = into, 0
    after[FIRST:PAD] = after[:SYMBOLS, [START]]
    emits[FIRST:PAD] = emits[:SYMBOLS, [START]]
    after[PAD] = np.arange(STATES)
    return after.ravel(), emits.ravel()


def compose(after: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive parallel prefix scan of chunk maps ``(exit state, emitted)`` by entry state."""
    step = 1
    while step < len(after):
        first, second = after[:-step], after[step:]
        joined = np.take_along_axis(second, first, axis=1)
        counts = emitted[:-step] + np.take_along_axis(emitted[step:], first, axis=1)
        after = np.concatenate([after[:step], joined])
        emitted = np.concatenate([emitted[:step], counts])
        step *= 2
    return after, emitted


class PreTokens:
    """The pre-token machine of one tokenizer."""

    def __init__(self, tokenizer):
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes = np.zeros(0x110000, np.uint8)
        self.known = np.zeros(0x1100, bool)
        self.after, self.emits = pre_token_tables()

    def learn(self, block: int) -> None:
        """Ask the library for the classes of 256 code points."""
        for code in range(block * 256, block * 256 + 256):
            if 0xD800 <= code < 0xE000:
                continue
            kinds = [k for k, c in ((LETTER, "a"), (NUMBER, "1"), (MARK, "!")) if len(self.cut(c + chr(code))) == 1]
            self.classes[code] = kinds[0] if kinds else SPACE
        self.known[block] = True

    def symbols(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        for block in np.unique(codes >> 8):
            if not self.known[block]:
                self.learn(block)
        kind = self.classes[codes]
        last = np.zeros(len(codes), bool)
        last[firsts[1:] - 1] = last[-1] = True
        follow = np.append(codes[1:], 0)
        follow[last] = 0
        third = np.append(follow[1:], 0)
        more_space = last | np.append(kind[1:] == SPACE, True)
        symbol = np.array([SYM_LETTER, SYM_NUMBER, SYM_MARK, SPACE_LAST], np.uint8)[kind]
        blank = codes == ord(" ")
        symbol[blank] = BLANK_LAST
        space = kind == SPACE
        symbol[space & ~blank & more_space] = SPACE_IN
        symbol[blank & more_space] = BLANK_IN
        quote = codes == ord("'")
        if quote.any():
            second = np.where(follow == 0, 0, third)
            short = np.isin(follow, [ord(c) for c in "stmd"])
            pair = (follow.astype(np.int64) << 32) | second
            long = np.isin(pair, [(ord(a) << 32) | ord(b) for a, b in ("re", "ve", "ll")])
            symbol[quote & long] = SYM_LONG
            symbol[quote & short] = SYM_SHORT
        symbol[firsts] += FIRST
        return symbol

    def starts(self, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Positions where a pre-token begins; ``firsts`` are the first positions of texts."""
        symbol = self.symbols(codes, firsts)
        chunks = -(-len(symbol) // CHUNK)
        grid = np.full(chunks * CHUNK, PAD, np.uint8)
        grid[: len(symbol)] = symbol
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T).astype(np.intp) * STATES
        state = np.tile(np.arange(STATES, dtype=np.intp), (chunks, 1))
        emitted = np.zeros((chunks, STATES), np.int64)
        for row in grid:
            at = row[:, None] + state
            emitted += self.emits[at]
            state = self.after[at].astype(np.intp)
        exits, totals = compose(state, emitted)
        entry = np.concatenate([[START], exits[:-1, START]]).astype(np.intp)
        begins = np.empty((CHUNK, chunks), np.uint8)
        for row, out in zip(grid, begins):
            at = row + entry
            out[:] = self.emits[at]
            entry = self.after[at].astype(np.intp)
        found = np.flatnonzero(begins.T.ravel())
        assert len(found) == totals[-1, START]
        return found


# --- merge machine ----------------------------------------------------------------------

#: States after which the merge machine is compiled anew (about 250 MB).
MAX_STATES = 400_000
SLOTS = 1 << 22
#: Lanes below which the rest of each long pre-token is run alone.
FEW_LANES = 16


class Merges:
    """The merge machine: lazily compiled, weighted transitions in an open hash table."""

    def __init__(self, tokenizer):
        self.tokenize = tokenizer.model.tokenize
        self.spell = byte_letters()
        byte_of = {letter: chr(byte) for byte, letter in self.spell.items()}
        self.tokens = {
            "".join(map(byte_of.__getitem__, token))
            for token in tokenizer.get_vocab(with_added_tokens=False)
            if all(letter in byte_of for letter in token)
        }
        self.growing = {token[:n] for token in self.tokens for n in range(1, len(token))}
        self.reset()

    def reset(self) -> None:
        start = ("", ((0, None, 0),))
        self.states, self.number = [start], {start: 0}
        self.beside: dict[tuple[str, str], bool] = {}
        self.keys = np.full(SLOTS, -1, np.int64)
        self.after = np.zeros(SLOTS, np.int32)
        self.weights = np.zeros(SLOTS, np.int8)
        self.used = 0

    def side_by_side(self, left: str, right: str) -> bool:
        pair = (left, right)
        if pair not in self.beside:
            found = [t.value for t in self.tokenize((left + right).translate(self.spell))]
            self.beside[pair] = found == [left.translate(self.spell), right.translate(self.spell)]
        return self.beside[pair]

    def step(self, state, byte: str):
        """(next state, change of the count). A state is the growing suffix and, longest first,
        (length of a growing suffix, token that ends before it or None, its count minus now)."""
        suffix, places = state
        text = suffix + byte
        for length, before, count in places:
            token = text[len(text) - length - 1 :]
            if token in self.tokens and (before is None or self.side_by_side(before, token)):
                break
        else:
            raise ValueError(f"no token of this vocabulary ends {text!r}")
        weight = count + 1
        kept_places = tuple(
            (length + 1, before, count - weight)
            for length, before, count in places
            if text[len(text) - length - 1 :] in self.growing
        ) + ((0, token, 0),)
        longest = kept_places[0][0]
        return (text[len(text) - longest :] if longest else "", kept_places), weight

    @staticmethod
    def slot(keys):
        return (keys * 0x9E3779B1 >> 7) & (SLOTS - 1)

    def compile(self, key: int) -> None:
        state, weight = self.step(self.states[key >> 8], chr(key & 0xFF))
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        at = int(self.slot(key))
        while self.keys[at] >= 0:
            at = (at + 1) & (SLOTS - 1)
        self.keys[at], self.after[at], self.weights[at] = key, number, weight
        self.used += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Table places of transitions; missing ones are compiled first."""
        at = self.slot(keys)
        seen = self.keys[at]
        wrong = np.flatnonzero(seen != keys)
        missing = []
        while len(wrong):
            empty = seen[wrong] < 0
            missing.append(wrong[empty])
            wrong = wrong[~empty]
            at[wrong] = (at[wrong] + 1) & (SLOTS - 1)
            seen[wrong] = self.keys[at[wrong]]
            wrong = wrong[seen[wrong] != keys[wrong]]
        missing = np.concatenate(missing) if missing else ()
        if len(missing):
            for key in np.unique(keys[missing]).tolist():
                self.compile(key)
            at[missing] = self.find(keys[missing])
        return at

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token ``data[start : start + length]``."""
        if len(self.states) > MAX_STATES or self.used > SLOTS // 2:
            self.reset()
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state = np.zeros(len(starts), np.int64)
        count = np.zeros(len(starts), np.int64)
        lanes_at = len(starts) - np.searchsorted(lengths[::-1], np.arange(lengths[0] + 1), "right")
        done = 0
        for position, lanes in enumerate(lanes_at.tolist()):
            if lanes <= FEW_LANES:
                break
            at = self.find(state[:lanes] << 8 | data[starts[:lanes] + position])
            state[:lanes] = self.after[at]
            count[:lanes] += self.weights[at]
            done = position + 1
        for lane in range(min(FEW_LANES, len(starts))):
            now, total = int(state[lane]), 0
            for byte in data[starts[lane] + done : starts[lane] + lengths[lane]].tolist():
                key = now << 8 | byte
                at = int(self.slot(key))
                while self.keys[at] != key:
                    if self.keys[at] < 0:
                        self.compile(key)
                    else:
                        at = (at + 1) & (SLOTS - 1)
                now, total = int(self.after[at]), total + int(self.weights[at])
            count[lane] += total
        out = np.empty_like(count)
        out[order] = count
        return out


# --- texts ------------------------------------------------------------------------------


class Counter:
    """Token counts of texts, equal to the tokenizers library's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.normalizer:
            raise ValueError("only plain byte-level BPE vocabularies can be compiled")
        self.pre_tokens, self.merges = PreTokens(tokenizer), Merges(tokenizer)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.has_special = bool(special)

    def parts(self, text: str):
        """(texts to encode apart, special tokens between them)."""
        texts, extra = [text], 0
        if self.has_special and self.special.search(text):
            texts = self.special.split(text)
            extra = len(texts) - 1
        for some in texts:
            start = 0
            while len(some) - start > 2 * BATCH_CHARS:
                # A blank after a non-space always starts a pre-token.
                cut = some.find(" ", start + BATCH_CHARS)
                while cut > 0 and some[cut - 1].isspace():
                    cut = some.find(" ", cut + 1)
                if cut < 0:
                    break
                yield some[start:cut], 0
                start = cut
            yield some[start:], 0
        yield "", extra

    def count(self, texts: list[str | None]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            for part, extra in self.parts(text or ""):
                totals[i] += extra
                if part:
                    waiting.append(part)
                    owners.append(i)
                    size += len(part)
                if size >= BATCH_CHARS:
                    self._add(totals, waiting, owners)
                    waiting, owners, size = [], [], 0
        if waiting:
            self._add(totals, waiting, owners)
        return totals

    def _add(self, totals: np.ndarray, texts: list[str], owners: list[int]) -> None:
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        firsts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
        starts = self.pre_tokens.starts(codes, firsts)
        data = np.frombuffer(joined.encode(), np.uint8)
        if len(data) == len(codes):
            places = starts
        else:
            width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            places = (np.cumsum(width) - width)[starts]
        lengths = np.diff(places, append=len(data))
        counts = self.merges.counts(data, places, lengths)
        owner = np.asarray(owners)[np.searchsorted(firsts, starts, "right") - 1]
        totals += np.bincount(owner, counts, len(totals)).astype(np.int64)


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(
    docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        counter = kept(("token counter", vocabulary), lambda: Counter(vocabulary))
        for batch in batches:
            tokens = counter.count(batch.column(1).to_pylist())
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, COUNTS)
