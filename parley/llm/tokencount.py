"""Token counts by a compiled finite-state transducer, without building the tokens.

The vocabulary is compiled, state by state as texts need them, into a deterministic transducer
over characters. A state is what the characters read so far leave open: every recent place
from which a longer piece may still grow, the last token before that place, and how many fewer
tokens stood there. The transition on a character is annotated with the change of the token
count (it may be negative, when a longer piece replaces shorter ones). Two pieces may stand
side by side only if merging their joined text gives these two pieces again; so exactly one
last token is possible after every prefix, and the transducer is deterministic.

A space that follows another character brings the transducer back to its start state, since no
piece holds one inside. A chunk of text is therefore a state map of three parts: the open head
before its first such place, the count between the first and the last, and the open tail. Maps
compose associatively, so chunks of one long text are read by different tasks and their maps
are joined by a tree-shaped scan. What a worker has compiled it keeps from task to task. A chunk without such a place is all open head, that is raw text;
a run without spaces is therefore put together again and read by one task, however long it is.

Rows: every input row gives one output row, repeated rows included. A null text counts as
empty and has no tokens; a null id stays null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Known, map_rows, text_bytes, worker_kept

CHUNK = 1 << 16  # characters of one chunk of a long text
CACHED_SEGMENTS = 300_000  # segments whose counts a worker remembers, in two generations
CACHED_SEGMENT = 64  # longest segment that is remembered
CACHED_STATES = 400_000  # states a worker holds, and transitions and checked pairs, in two generations
STRETCH = 1 << 16  # characters after which a long segment looks at the number of states
LETTER_BITS = 21
SPACE = "▁"  # fixed value: the vocabulary's sign for a space
LINE = "\n"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
Map = tuple[str, int, str] | tuple[str, None, None]  # head, count, tail; no boundary: head only


class Transducer:
    """Deterministic token counter of one piece vocabulary with scores and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        )
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        lone = {c for p in self.scores for c in p} - set(self.scores)
        if lone:
            raise ValueError(f"letters that are no pieces, such as {min(lone)!r}")
        crossing = [p for p in self.scores if re.search(f"[^{SPACE}]{SPACE}", p)]
        if crossing:
            raise ValueError(f"pieces that cross a word start, such as {crossing[0]!r}")
        self.tree: dict = {}
        for piece in self.scores:
            if self.merge(piece) != [piece]:
                continue  # merging never yields it
            node = self.tree
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = piece
        self.growth = Known(len(self.scores) + 1, self._grown)
        self.pairs = Known(CACHED_STATES, self._stand)
        self.forget()
        short = CACHED_SEGMENT.__ge__
        self.known = Known(CACHED_SEGMENTS, self.run, lambda text: short(len(text)))
        self.words = Known(CACHED_SEGMENTS, self._word, lambda text: short(len(text)))
        # a line break is no piece, and nothing merges with its byte
        self.breaks = LINE not in self.tree

    @classmethod
    def shared(cls, path: str) -> Transducer:
        """One transducer for all tasks of a worker."""
        return worker_kept(f"transducer {path}", lambda: cls(path))

    def forget(self) -> None:
        """Drop the compiled states; state 0 is the start."""
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps = Known(CACHED_STATES, self._step)  # state and letter: next state and change, packed
        self.start = self._number(((self.tree, None, 0),))

    def _number(self, state: tuple) -> int:
        key = tuple((id(node), last, fewer) for node, last, fewer in state)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(state)
        return self.numbers[key]

    def merge(self, text: str) -> list[str]:
        """Merge the best scored neighbours, the leftmost of equals, until none is a piece."""
        parts: list[str | None] = list(text)
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue: list = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < size:
                joined = parts[left] + parts[after[left]]
                score = self.scores.get(joined)
                if score is not None:
                    heapq.heappush(queue, (-score, left, joined))

        for left in range(size - 1):
            offer(left)
        while queue:
            _, left, joined = heapq.heappop(queue)
            if parts[left] is None or after[left] >= size:
                continue
            right = after[left]
            if parts[left] + parts[right] != joined:
                continue
            parts[left], parts[right] = joined, None
            after[left] = after[right]
            if after[right] < size:
                before[after[right]] = left
            offer(left)
            offer(before[left])
        return [p for p in parts if p is not None]

    def _grown(self, piece: str) -> tuple[list[float], list[str], list[str]]:
        """Scores of the merges that make a piece, in their order, and its outer parts before each."""
        parts, scores, firsts, lasts = list(piece), [], [piece[0]], [piece[-1]]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return scores, firsts, lasts

    def _stand(self, pair: tuple[str | None, str]) -> bool:
        """Whether two pieces may stand side by side: no merge across the seam comes first.

        Until one does, either piece grows as it does alone, so only its outer parts matter.
        """
        left, right = pair
        if left is None:
            return True
        (scores, _, lasts), (others, firsts, _) = self.growth[left], self.growth[right]
        i, j, n, m, look = 0, 0, len(scores), len(others), self.scores.get
        while True:
            across = look(lasts[i] + firsts[j])
            mine = scores[i] if i < n else None
            other = others[j] if j < m else None
            if across is not None and (mine is None or across > mine) and (other is None or across >= other):
                return False
            if mine is not None and (other is None or mine >= other):
                i += 1
            elif other is not None:
                j += 1
            else:
                return True

    def _compile(self, state: int, letter: str) -> tuple[int, int]:
        """The transition of a state on a letter: next state, change of the count."""
        if letter not in self.tree or "" not in self.tree[letter]:
            # no piece: its bytes are tokens, and nothing merges with them
            return self.start, len(letter.encode("utf-8", "surrogatepass"))
        grown, last, change = [], None, None
        for node, before, fewer in self.states[state]:
            node = node.get(letter)
            if node is None:
                continue
            grown.append((node, before, fewer))
            piece = node.get("")
            if change is None and piece is not None and self.pairs[before, piece]:
                last, change = piece, 1 - fewer
        live = [
            (node, before, fewer + change)
            for node, before, fewer in grown
            if len(node) > ("" in node)
        ]
        return self._number((*live, (self.tree, last, 0))), change

    def _step(self, packed: int) -> int:
        state, letter = packed >> LETTER_BITS, packed & (1 << LETTER_BITS) - 1
        after, change = self._compile(state, chr(letter))
        return after << 8 | change + 128

    def run(self, text: str) -> int:
        """Tokens of a text read from the start state."""
        state, total = self.start, 0
        for start in range(0, len(text), STRETCH):
            if len(self.states) >= CACHED_STATES:
                open_state = self.states[state]
                self.forget()
                state = self._number(open_state)
            steps = self.steps
            for letter in map(ord, text[start : start + STRETCH]):
                step = steps[state << LETTER_BITS | letter]
                state = step >> 8
                total += (step & 255) - 128
        return total

    def segment(self, text: str) -> int:
        """Tokens of a run of spaces with the characters up to the next space."""
        return self.known[text]

    def _word(self, word: str) -> int:
        """Tokens of what lies between two spaces, with the first of them; none before a line break."""
        return self.run(word if word.startswith(LINE) else SPACE + word)

    def chunk(self, text: str) -> Map:
        """The state map of a piece of spaced text; cut anywhere."""
        found = SEGMENT.findall(text)
        lead = len(text) - sum(map(len, found))
        if lead == 0 and found:
            # a leading run of spaces may go on from the chunk before
            head, found = found[0], found[1:]
        else:
            head = text[:lead]
        if not found:
            return head, None, None
        return head, sum(map(self.segment, found[:-1])), found[-1]

    def join(self, left: Map, right: Map) -> Map:
        """The map of two neighbouring chunks."""
        head, count, tail = left
        start, mid, end = right
        open_end = head if tail is None else tail
        if start.startswith(SPACE) and not open_end.endswith(SPACE):  # the seam is a boundary
            count = 0 if tail is None else count + self.segment(tail)
            if end is None:
                return head, count, start
            return head, count + self.segment(start) + mid, end
        if tail is None:
            return head + start, mid, end
        if end is None:
            return head, count, tail + start
        return head, count + self.segment(tail + start) + mid, end

    def close(self, whole: Map) -> int:
        """Tokens of a text whose map is complete."""
        head, count, tail = whole
        return self.segment(head) + (0 if tail is None else count + self.segment(tail))

    def scan(self, maps: list[Map]) -> Map:
        """Compose maps of consecutive chunks pairwise, level by level."""
        while len(maps) > 1:
            joined = [self.join(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = joined + maps[len(joined) * 2 :]
        return maps[0]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if text[0] == " " or text[0] == LINE or "  " in text or SPACE in text or not self.breaks:
            return sum(map(self.known.__getitem__, SEGMENT.findall(spaced(text))))
        # single spaces: words stand alone, and so do the starts of lines
        return sum(map(self.words.__getitem__, text.replace(LINE, " " + LINE).split(" ")))


def spaced(text: str) -> str:
    """The text as the vocabulary sees it: a leading space, and signs for spaces."""
    return SPACE + text.replace(" ", SPACE)


def _short(source: DataFrame, path: str, kind: str) -> DataFrame:
    def make():
        counter = Transducer.shared(path)

        def work(rows):
            for key, size, text in zip(rows["key"], rows["n_bytes"], rows["text"]):
                yield key, size, counter.count(text)

        return work

    return map_rows(source, f"key {kind}, n_bytes bigint, n_tokens bigint", make)


def _long(source: DataFrame, path: str, kind: str, chunk: int) -> DataFrame:
    """Cut long texts into chunk rows, deal these to all tasks, compose the maps by text."""
    named = f"key {kind}, name string, n_bytes bigint, i int"

    def make_chunks():
        def work(rows):
            for key, name, size, text in zip(*(rows[c] for c in ("key", "name", "n_bytes", "text"))):
                text = spaced(text)
                for i in range(-(-len(text) // chunk)):
                    yield key, name, size, i, text[i * chunk : (i + 1) * chunk]

        return work

    def make_maps():
        counter = Transducer.shared(path)

        def work(rows):
            *ids, parts = (rows[c] for c in ("key", "name", "n_bytes", "i", "part"))
            for *own, part in zip(*ids, parts):
                yield (*own, *counter.chunk(part))

        return work

    def compose(group: pa.Table) -> pa.Table:
        counter = Transducer.shared(path)
        rows = {row["i"]: row for row in group.to_pylist()}
        maps = [tuple(rows[i][c] for c in ("head", "mid", "tail")) for i in sorted(rows)]
        copies = group.num_rows // len(rows)  # repeated rows have the same chunks
        columns = group.slice(0, 1).select(["key", "n_bytes"])
        total = pa.array([counter.close(counter.scan(maps))], pa.int64())
        return pa.concat_tables([columns.append_column("n_tokens", total)] * copies)

    chunks = map_rows(
        source.withColumn("name", F.sha2("text", 256)), f"{named}, part string", make_chunks
    )
    maps = map_rows(
        chunks.repartition(F.col("name"), F.col("i")),
        f"{named}, head string, mid bigint, tail string",
        make_maps,
    )
    return maps.groupBy("key", "name").applyInArrow(
        compose, f"key {kind}, n_bytes bigint, n_tokens bigint"
    )


def count_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
) -> DataFrame:
    """``id, n_bytes, n_tokens`` of every whole text.

    Texts of up to ``chunk`` characters are counted where they lie; the chunks of longer ones
    are counted by all tasks.
    """
    source = docs.select(docs[id_col].alias("key"), text_bytes(text_col).alias("text"))
    source = source.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    kind = source.schema["key"].dataType.simpleString()
    is_long = F.length("text") > chunk
    short = _short(source.where(~is_long), path, kind)
    long = _long(source.where(is_long), path, kind, chunk)
    return short.unionByName(long).withColumnRenamed("key", id_col)
