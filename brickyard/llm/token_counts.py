"""Token counts by trie-shared dynamic programming over unigram scores.

A pre-token is U+2581 and a word; its tokens are the pieces of its best-scoring segmentation
(ties: fewer pieces). A worker keeps a trie of the distinct pre-tokens it has met. A node has the forward
score of its prefix (the best score and its piece count), computed once, when the first pre-token with
that prefix is inserted; later ones start from the deepest node they share, in whatever batch they come.
The count at a pre-token's last node is its terminal count, and every occurrence reads it. Texts are not
shuffled. The trie is bounded by ``NODES``: when it is full it is begun anew, which only repeats work.

Characters without a piece cost one token for each of their UTF-8 bytes.

Defined results: a null or empty text, or one without words, has 0 pre-tokens and 0 tokens;
null ids stay null; repeated rows are counted each; an empty table gives an empty result;
columns other than id and text are ignored; words of any length are scored whole.
"""

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm._shared import release, small_batches

#: Nodes of a worker's trie, about 150 bytes each.
NODES = 1_000_000
_models: dict[tuple[str, str], "UnigramCounter"] = {}


def load_pieces(path: str, scores: str = "rank") -> dict[str, float]:
    """Piece -> log score of a sentencepiece model; "rank": Zipf's law over merge order, for models without log scores."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if scores == "model":
        return {sp.id_to_piece(i): sp.get_score(i) for i in plain}
    ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    return {sp.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ranked)}


class UnigramCounter:
    def __init__(self, pieces: dict[str, float]):
        self.byte = min(pieces.values(), default=0.0) - 10.0
        # Every suffix of a piece, with its score if it is a piece itself: scans for pieces that end at a place stop early.
        self.ends: dict[str, float | None] = {}
        for piece in pieces:
            for i in range(len(piece)):
                self.ends.setdefault(piece[i:])
        self.ends.update(pieces)
        self._clear()

    def _clear(self) -> None:
        # Node 0 is the empty prefix. A child is found by its parent's number and its character.
        self.child: dict[int, int] = {}
        self.parent, self.best, self.pieces = [0], [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def _insert(self, word: bytes) -> int:
        """The pre-token's terminal count."""
        token = "\u2581" + word.decode()
        node = depth = 0
        for depth, char in enumerate(token):  # down to the deepest node that is there
            below = self.child.get(node << 21 | ord(char))
            if below is None:
                break
            node = below
        else:
            return self.pieces[node]
        ends, none, parent = self.ends, self, self.parent
        for end in range(depth + 1, len(token) + 1):
            top, count, start = -math.inf, 0, node
            for begin in range(end - 1, -1, -1):
                score = ends.get(token[begin:end], none)
                if score is none:
                    break
                if score is not None:
                    score += self.best[start]
                    if score > top or score == top and self.pieces[start] + 1 < count:
                        top, count = score, self.pieces[start] + 1
                start = parent[start]
            if ends.get(token[end - 1]) is None:
                size = len(token[end - 1].encode())
                score = self.best[node] + self.byte * size
                if score > top:
                    top, count = score, self.pieces[node] + size
            new = len(parent)
            self.child[node << 21 | ord(token[end - 1])] = new
            parent.append(node)
            self.best.append(top)
            self.pieces.append(count)
            node = new
        return self.pieces[node]

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        out = []
        for text in texts:
            words = (text or "").encode().split()
            new = set(words).difference(self.terminal)
            if len(self.parent) > NODES:
                self._clear()
                new = set(words)
            for word in new:
                self.terminal[word] = self._insert(word)
            out.append((len(words), sum(map(self.terminal.__getitem__, words))))
        return out

    def rest(self) -> None:
        """Between tasks a worker holds no more than a small trie."""
        if len(self.parent) > NODES // 4:
            self._clear()


def token_counts(docs: DataFrame, model: str, scores: str = "rank", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens."""
    small_batches(docs.sparkSession)

    def run(batches):
        key = (model, scores)
        if key not in _models:
            _models[key] = UnigramCounter(load_pieces(model, scores))
        counter = _models[key]
        for batch in batches:
            found = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])
        counter.rest()
        release()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
