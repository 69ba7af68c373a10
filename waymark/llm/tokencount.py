"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers count the tokens of a byte-level BPE tokenizer with
word ends, without building them. The first splits a text into words. Its state
maps over chunks of the text (for every state before a chunk, the state behind
it) are made side by side and composed by a parallel prefix scan; then every chunk
runs from its true state. The second counts a word's tokens: it reads one byte
at a time, and each transition carries by how much the number of tokens grows or
shrinks. It is compiled as far as the words met need it. Words are cut into
chunks, and all chunks of a batch run through it side by side: one that does not
begin its word from the state that some bytes before it lead to. A chunk's map so
has one entry state that is known; the maps and their counts are composed by a
prefix scan, and where a chunk was entered in another state, its map gets that one
too, until all maps of a word meet.

What the classes of characters are, what is lower case, and how characters compose,
is asked of the library itself, for every character.

The second transducer rests on two properties of BPE: the tokens of a prefix of
a word end in one token t, and what precedes t is tokenized as if it stood alone;
and tokens are a word's tokens if every two neighbours are the tokens of their
joint text. So the last token of each prefix follows from the last tokens of a
few prefixes before it, and those are the state.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import table

#: More tokens than this make a document over_limit.
LIMIT = 2048
#: The tokenizer whose pattern the first transducer follows; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The normaliser that is followed; fixed values.
NORMALISER = ["NFC", "Replace", "Lowercase"]
#: Characters of a chunk; of the texts taken at a time.
CHUNK, PIECE = 64, 1 << 20
#: Bytes of a chunk of a word, bytes before it that its state is guessed from, and
#: bytes of the chunks that run side by side.
WORD_CHUNK, LOOK_BACK, SIDE_BY_SIDE = 64, 32, 1 << 16
#: Words and bytes of them remembered, states compiled, and pairs of tokens looked at, before a worker starts anew.
KNOWN_WORDS, KNOWN_BYTES, MAX_STATES, MAX_PAIRS = 1 << 19, 1 << 24, 1 << 18, 1 << 20
#: Columns by which the transition table grows; it has twice the rows when it grows.
FIRST_STATES, MORE_SYMBOLS = 1 << 14, 32

# classes of characters
SPACE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, ELL, E = range(10)
# states of the first transducer: outside a token, in letters, in other signs,
# behind a leading quote, and behind quote and r, v or l
OUT, IN_LETTERS, IN_OTHER, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
#: What a transition says: a token starts here, or one started one character before.
STARTS, STARTED = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and outputs of the first transducer, by state and class."""
    to, out = np.zeros((7, 10), dtype=np.uint8), np.zeros((7, 10), dtype=np.uint8)
    letters = (LETTER, STMD, R, V, ELL, E)
    for state in range(7):
        for c in range(10):
            came = IN_LETTERS if state in (QUOTED_R, QUOTED_V, QUOTED_L) else state
            said = STARTED if came != state else 0
            if (state, c) in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, ELL), (QUOTED, STMD)):
                to[state, c], out[state, c] = OUT, 0
            elif state == QUOTED and c in (R, V, ELL):
                to[state, c], out[state, c] = {R: QUOTED_R, V: QUOTED_V, ELL: QUOTED_L}[c], 0
            elif c == SPACE:
                to[state, c], out[state, c] = OUT, said
            elif c == NUMBER:
                to[state, c], out[state, c] = OUT, said | STARTS
            elif c in letters:
                to[state, c], out[state, c] = IN_LETTERS, said | (came != IN_LETTERS) * STARTS
            else:
                inside = came in (IN_OTHER, QUOTED)
                to[state, c] = IN_OTHER if inside or c == OTHER else QUOTED
                out[state, c] = said | (not inside) * STARTS
    return to, out


_TO, _SAYS = _splitter()


@dataclass
class Alphabet:
    """The class of every code point, and whether Python's tables and the library's
    may treat it differently (texts with such are normalised by the library)."""

    kinds: np.ndarray
    strange: np.ndarray


@cache
def library_alphabet() -> Alphabet:
    """As the tokenizers library has it, asked once for each code point."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    chars = "".join(map(chr, codes))
    place = np.array(codes)
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for _, (first, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(chars):
            kinds[place[first:end]] = kind
    for own, kind in (("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", ELL), ("e", E)):
        for c in own:
            kinds[ord(c)] = kind
    strange = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    probes = [
        (normalizers.Lowercase(), str.lower, "{}"),
        (normalizers.NFD(), lambda x: unicodedata.normalize("NFD", x), "{}"),
        (normalizers.NFD(), lambda x: unicodedata.normalize("NFD", x), "a{}\u0334"),
    ]
    for library, python, frame in probes:
        asked = [frame.format(c) for c in chars if c != "\n"]
        for c, x, found in zip(filter("\n".__ne__, chars), asked, library.normalize_str("\n".join(asked)).split("\n")):
            if python(x) != found:
                strange[[ord(c), *map(ord, python(c)), *map(ord, found)]] = True
    strange[: 0x80] = False
    return Alphabet(kinds, strange)


def entry_states(maps: np.ndarray) -> np.ndarray:
    """The state before each chunk, given the chunks' state maps, from the state
    OUT before the first: an inclusive scan in which each step composes maps that
    lie twice as far apart."""
    maps = maps.copy()
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return np.concatenate(([OUT], maps[:-1, OUT])).astype(np.uint8)


def composed(meets: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Whether each chunk's map composes with those of all chunks before it back to
    the last fresh one (whose entry state is sure), given whether each meets the one
    before: an inclusive scan that joins ranges twice as long in each step."""
    ok, closed = meets.copy(), fresh.copy()
    step = 1
    while step < len(ok):
        ok[step:] &= closed[step:] | ok[:-step]
        closed[step:] |= closed[:-step]
        step *= 2
    return ok


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def word_spans(text: str, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a normalised text start and end, by the class of each code point."""
    kinds = np.append(kinds[code_points(text)], SPACE)  # the space settles what is open
    n = len(kinds)
    padded = np.zeros(-(-n // CHUNK) * CHUNK, dtype=np.uint8)
    padded[:n] = kinds
    chunks = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
    to, says = _TO.ravel(), _SAYS.ravel()
    maps = np.tile(np.arange(7, dtype=np.uint8), (chunks.shape[1], 1))
    for column in chunks:
        maps = to[maps * np.uint8(10) + column[:, None]]
    state = entry_states(maps)
    said = np.empty_like(chunks)
    for k, column in enumerate(chunks):
        at = state * np.uint8(10) + column
        said[k], state = says[at], to[at]
    said = np.ascontiguousarray(said.T).ravel()[:n]
    begins = (said & STARTS) > 0
    begins[:-1] |= (said[1:] & STARTED) > 0
    edges = np.flatnonzero(begins | (kinds == SPACE))
    is_start = begins[edges]
    is_start[-1] = False
    at = np.flatnonzero(is_start)
    return edges[at], edges[at + 1]


class WordTransducer:
    """Counts the BPE tokens of words given as UTF-8; symbols are bytes, plus 256
    for a word's last one."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        byte_of = {c: b for b, c in _byte_characters().items()}
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        #: the merge that makes each token, and its two parts
        self.made = {a + b: (i, a, b) for i, (a, b) in enumerate(merges)}
        if len(self.made) < len(merges):
            raise ValueError("tokens that several merges make are not compiled here")
        self.end = end
        self.child: dict[tuple[int, int], int] = {}
        self.token_at: dict[int, str] = {}
        self.inner: set[int] = set()
        nodes = 1
        for token in vocab:
            final = token.endswith(end)
            try:
                symbols = [byte_of[c] for c in (token[: -len(end)] if final else token)]
            except KeyError:  # an added token, which is no bytes
                continue
            if not symbols:
                continue
            symbols[-1] += 256 * final
            node = 0
            for s in symbols:
                self.inner.add(node)
                if (node, s) not in self.child:
                    self.child[node, s] = nodes
                    nodes += 1
                node = self.child[node, s]
            self.token_at[node] = token
        self.alone: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states but the first, and what was found on the way."""
        self.states: list[tuple] = [((0, "", 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.column = np.full(512, -1, dtype=np.int64)
        self.symbols = 0
        self.to = np.full((0, 0), -1, dtype=np.int32)
        self.grows = np.zeros((0, 0), dtype=np.int8)
        self.widen(FIRST_STATES, MORE_SYMBOLS)

    def widen(self, states: int, symbols: int) -> None:
        by = ((0, states), (0, symbols))
        self.to = np.pad(self.to, by, constant_values=-1)
        self.grows = np.pad(self.grows, by)

    def merged(self, parts: list[str]) -> list[str]:
        """BPE as it is defined: the pair of the best rank first, from the left."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def symbols_of(self, token: str) -> list[str]:
        final = token.endswith(self.end)
        parts = list(token[: -len(self.end)] if final else token)
        if final:
            parts[-1] += self.end
        return parts

    def reachable(self, token: str) -> bool:
        if token not in self.alone:
            self.alone[token] = self.merged(self.symbols_of(token)) == [token]
        return self.alone[token]

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the two are the tokens of their joint text: no merge may take place
        across their border. Back in time, the border lies between the last part of
        the left token and the first of the right one; a part lives from the merge
        that made it to the one that used it up. A merge of the same rank goes first where
        it is further left."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._kept_apart(left, right)
        return known

    def _kept_apart(self, left: str, right: str) -> bool:
        never = len(self.ranks)
        used_left = used_right = never
        while True:
            rank = self.ranks.get((left, right), never)
            if rank < used_left and rank <= used_right and rank < never:
                return False
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or made_left is not None and made_left[0] > made_right[0]:
                used_left, left = made_left[0], made_left[2]
            else:
                used_right, right = made_right[0], made_right[1]

    def compile(self, state: int, symbol: int) -> None:
        """Add one transition. A state has, for every place behind which a token
        may still be open, the trie's node from there on, the last token before
        it, and the number of tokens before it less that of the whole prefix."""
        went = [(self.child[node, symbol], last, less) for node, last, less in self.states[state] if (node, symbol) in self.child]
        token, grows = next((self.token_at[n], less + 1) for n, last, less in went if n in self.token_at and self.reachable(self.token_at[n]) and (not last or self.neighbours(last, self.token_at[n])))
        if symbol >= 256:
            target = 0
        else:
            after = (*((n, last, less - grows) for n, last, less in went if n in self.inner), (0, token, 0))
            target = self.number.setdefault(after, len(self.states))
            if target == len(self.states):
                self.states.append(after)
                if target == len(self.to):
                    self.widen(len(self.to), 0)
        self.to[state, self.column[symbol]], self.grows[state, self.column[symbol]] = target, grows

    def run(self, spans: list[bytes], entry: list[int], ends: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens each span adds, and the state behind it, from its entry
        state; ends says whether a span's last byte is its word's."""
        length = np.array([len(x) for x in spans], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        data = np.frombuffer(b"".join(spans), dtype=np.uint8).astype(np.int64)
        if len(data):
            last = (np.cumsum(length) - 1)[np.array(ends) & (length > 0)]
            data[last] += 256
        start = (np.cumsum(length) - length)[order]
        length = length[order]
        for s in np.unique(data):
            if self.column[s] < 0:
                self.column[s] = self.symbols
                self.symbols += 1
                if self.symbols == self.to.shape[1]:
                    self.widen(0, MORE_SYMBOLS)
        total = np.zeros(len(spans), dtype=np.int64)
        state = np.array(entry, dtype=np.int64)[order]
        for k in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -k, side="left"))
            symbol = data[start[:active] + k]
            column, now = self.column[symbol], state[:active]
            target = self.to[now, column]
            if (target < 0).any():
                for own, s in {*zip(now[target < 0].tolist(), symbol[target < 0].tolist())}:
                    self.compile(own, s)
                target = self.to[now, column]
            total[:active] += self.grows[now, column]
            state[:active] = target
        added, behind = np.empty_like(total), np.empty_like(state)
        added[order], behind[order] = total, state
        return added, behind

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each non-empty word."""
        chunks: list[tuple[int, int]] = []
        size, first, out = 0, 0, []
        for i, word in enumerate(words):
            chunks += [(i, at) for at in range(0, len(word), WORD_CHUNK)]
            size += len(word)
            if size > SIDE_BY_SIDE or i == len(words) - 1:
                out.append(self._composed(words, chunks, first, i + 1))
                chunks, size, first = [], 0, i + 1
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def _composed(self, words: list[bytes], chunks: list[tuple[int, int]], first: int, end: int) -> np.ndarray:
        """The counts of words[first:end], of which chunks are the (word, place)s:
        a group of them at a time, which goes on from the state behind the group before."""
        total = np.zeros(end - first, dtype=np.int64)
        step = SIDE_BY_SIDE // WORD_CHUNK
        before: tuple = self.states[0]  # of a word that goes on from the group before
        for at in range(0, len(chunks), step):
            if len(self.states) > MAX_STATES:
                self.clear()
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            own = chunks[at : at + step]
            word = np.array([i for i, _ in own])
            spans = [words[i][k : k + WORD_CHUNK] for i, k in own]
            ends = [k + WORD_CHUNK >= len(words[i]) for i, k in own]
            begins = np.array([k == 0 for _, k in own])
            true = np.where(begins, 0, -1)
            if not begins[0]:
                true[0] = self._number(before)
            guessed = np.flatnonzero(true < 0)
            entry = np.maximum(true, 0)
            if len(guessed):
                looks = [words[own[k][0]][max(0, own[k][1] - LOOK_BACK) : own[k][1]] for k in guessed.tolist()]
                entry[guessed] = self.run(looks, [0] * len(looks), [False] * len(looks))[1]
            added, behind = self._met(spans, entry, ends, true) if (true < 0).any() else self.run(spans, entry.tolist(), ends)
            np.add.at(total, word - first, added)
            before = self.states[int(behind[-1])]
        return total

    def _number(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.to):
                self.widen(len(self.to), 0)
        return self.number[state]

    def _met(self, spans: list[bytes], entry: np.ndarray, ends: list[bool], true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run chunks from guessed entry states, and again where the chunk before
        ends in another one; true has the entry states that are sure, else -1."""
        maps: dict[tuple[bytes, bool, int], tuple[int, int]] = {}
        while True:
            keys = list(zip(spans, ends, entry.tolist()))
            if new := list({k for k in keys if k not in maps}):
                maps.update(zip(new, zip(*(x.tolist() for x in self.run([k[0] for k in new], [k[2] for k in new], [k[1] for k in new])))))
            added, behind = np.array([maps[k] for k in keys], dtype=np.int64).T
            wanted = np.where(true >= 0, true, np.concatenate(([0], behind[:-1])))
            met = composed(wanted == entry, true >= 0)
            if met.all():
                return added, behind
            # the chain is right up to the first break; on from there by the maps that are known
            entry = np.where(wanted == entry, entry, wanted)
            k = int(np.flatnonzero(~met)[0])
            behind_now = int(wanted[k])
            while k < len(spans):
                entry[k] = true[k] if true[k] >= 0 else behind_now
                found = maps.get((spans[k], ends[k], int(entry[k])))
                if found is None:
                    break
                behind_now, k = found[1], k + 1


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary:
    itself where it is printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class TokenCounter:
    def __init__(self, path: str, alphabet: Alphabet | None = None) -> None:
        from tokenizers import normalizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or split["pattern"]["Regex"] != PATTERN or steps != NORMALISER:
            raise ValueError(f"{path} is not of the kind that is compiled here")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = WordTransducer(model["vocab"], merges, model["end_of_word_suffix"])
        self.alphabet = alphabet or library_alphabet()
        self.normaliser = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.known: dict[str, int] = {}
        self.known_bytes = 0
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"]))))

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text; a null text counts as empty. The
        strings of added tokens are one token each, wherever they stand."""
        totals = [0] * len(texts)
        taken: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for part in _pieces(text or ""):
                plain = self.special.split(part)
                totals[i] += len(plain) - 1
                for own in plain:
                    own = self.normalised(own)
                    taken.append((i, own))
                    size += len(own)
                if size > PIECE:
                    self._add(taken, totals)
                    taken, size = [], 0
        self._add(taken, totals)
        return totals

    def normalised(self, text: str) -> str:
        if not text.isascii() and self.alphabet.strange[code_points(text)].any():
            return self.normaliser.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _add(self, taken: list[tuple[int, str]], totals: list[int]) -> None:
        if not taken:
            return
        joined = "\n".join(x for _, x in taken)  # white space ends every token
        starts, ends = word_spans(joined, self.alphabet.kinds)
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.known) > KNOWN_WORDS or self.known_bytes > KNOWN_BYTES:
            self.known, self.known_bytes = {}, 0
        known = self.known
        fresh = list(set(words) - known.keys())
        if fresh:
            own = [w.encode("utf-8", "surrogatepass") for w in fresh]
            self.known_bytes += sum(map(len, own))
            known.update(zip(fresh, self.words.count(own).tolist()))
        counts = np.array([known[w] for w in words], dtype=np.int64)
        ends_at = np.cumsum([len(x) + 1 for _, x in taken])
        sums = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, ends_at)]
        for (i, _), n in zip(taken, np.diff(sums, prepend=0).tolist()):
            totals[i] += n


def _pieces(text: str) -> Iterator[str]:
    """The text, in parts that end at white space if it is long."""
    at = 0
    while len(text) - at > PIECE:
        cut = re.compile(r"[\t\n\r ]").search(text, at + PIECE)
        if cut is None:
            break
        # an added token holds no white space, so none is cut
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


_loaded: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, repeated rows
    and null ids included. Null and empty texts have no tokens. Other columns
    are not looked at, texts are never cut. path must be readable on every executor."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(library_alphabet())  # 2.2 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = TokenCounter(path, shared.value)
        for batch in batches:
            n = _loaded[path].count(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
