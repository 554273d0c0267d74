"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a trie over UTF-8 bytes with a failure link and a popped-token count per
node: where a text leaves the trie, the link leads to the node of what remains after the
longest pieces are taken off, and the count says how many those are. So each byte is read
once and no piece is built. The automaton (arrays, a few MB for tens of thousands of
pieces) is broadcast; its size is that of the vocabulary file, not of the data.

Words ``[^\\x20\\x09-\\x0D]+`` are counted with a mark in front, as the vocabulary writes a
word start; every byte is a piece of its own where nothing longer fits.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metaudit.llm.texts import per_text
from metaudit.llm.words import Texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"
LONG_WORD = 512  # bytes; longer words are run one by one


@dataclass
class Automaton:
    """Children as sorted keys ``node * 256 + byte``; link and popped count per node; node 0 is the root.

    ``rest`` is the number of pieces that what is read at a node comes to when the text ends there.
    """

    keys: np.ndarray
    child: np.ndarray
    link: np.ndarray
    popped: np.ndarray
    rest: np.ndarray

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child of each node by each byte, or -1."""
        key = node.astype(np.int64) * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)


def build(pieces: list[bytes]) -> Automaton:
    """The automaton of a vocabulary; all single bytes are added to it."""
    children: list[dict[int, int]] = [{}]
    is_piece = [False]
    for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
        node = 0
        for byte in piece:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                is_piece.append(False)
            node = children[node][byte]
        is_piece[node] = True
    # A link of None does not occur but at the root: any byte is a piece.
    link, popped, rest = [0] * len(children), [0] * len(children), [0] * len(children)
    queue = deque([0])
    while queue:
        parent = queue.popleft()
        for byte, node in children[parent].items():
            queue.append(node)
            if is_piece[node]:
                link[node], popped[node], rest[node] = 0, 1, 1
                continue
            at, count = link[parent], popped[parent]
            while byte not in children[at]:
                at, count = link[at], count + popped[at]
            link[node], popped[node] = children[at][byte], count
            rest[node] = count + rest[link[node]]
    keys = sorted((node * 256 + byte, child) for node, own in enumerate(children) for byte, child in own.items())
    return Automaton(np.array([k for k, _ in keys], np.int64), np.array([c for _, c in keys], np.int32),
                     np.array(link, np.int32), np.array(popped, np.int32), np.array(rest, np.int32))


def piece_counts(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 mark: bytes) -> np.ndarray:
    """Pieces of each word, all words stepped through the automaton side by side."""
    n = len(starts)
    node, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lengths = ends - starts
    long = np.flatnonzero(lengths > LONG_WORD)  # few words: a step of all of them would serve them alone
    alive = np.flatnonzero(lengths <= LONG_WORD)
    for k in range(len(mark) + int(lengths[alive].max(initial=0))):
        if k >= len(mark):
            alive = alive[lengths[alive] > k - len(mark)]
            byte = data[starts[alive] + k - len(mark)].astype(np.int64)
        else:
            byte = np.full(len(alive), mark[k], np.int64)
        todo, wanted = alive, byte
        while len(todo):
            to = automaton.step(node[todo], wanted)
            good = to >= 0
            node[todo[good]] = to[good]
            todo, wanted = todo[~good], wanted[~good]
            count[todo] += automaton.popped[node[todo]]
            node[todo] = automaton.link[node[todo]]
    pieces = count + automaton.rest[node]
    for word in long:
        pieces[word] = long_word_count(automaton, mark + data[starts[word]:ends[word]].tobytes())
    return pieces


def long_word_count(automaton: Automaton, word: bytes) -> int:
    """Pieces of one long word, byte by byte; the states it meets are kept."""
    known: dict[int, tuple[int, int]] = {}
    node, count = 0, 0
    for byte in word:
        found = known.get(node * 256 + byte)
        if found is None:
            at, popped, wanted = node, 0, np.array([byte])
            while (to := int(automaton.step(np.array([at]), wanted)[0])) < 0:
                popped += int(automaton.popped[at])
                at = int(automaton.link[at])
            found = known[node * 256 + byte] = to, popped
        node = found[0]
        count += found[1]
    return count + int(automaton.rest[node])


def counts(texts: Texts, automaton: Automaton, mark: bytes) -> list:
    """Words and pieces of each text; equal words of a slice are run once."""
    keys, inverse = np.unique(texts.word_hashes(), return_inverse=True)
    one = np.zeros(len(keys), np.int64)
    one[inverse] = np.arange(len(inverse))
    pieces = piece_counts(automaton, texts.data, texts.starts[one], texts.ends[one], mark)[inverse]
    sums = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(pieces, out=sums[1:])
    return [texts.n_words.astype(np.int64), sums[texts.first[1:]] - sums[texts.first[:-1]]]


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a sentence-piece model file that are text (no control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i).encode() for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY, pieces: list[bytes] | None = None,
                 mark: str = WORD_START, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words and n_pieces (greedy longest-match pieces of all words).

    ``vocabulary`` is a model file the driver can read; ``pieces`` gives a list instead.
    A null or empty text has 0 words and 0 pieces. Ids may be null or repeat; other columns
    are not read. Broadcasts the automaton only (about 30 bytes per trie node). A word of any length
    takes time in proportion to its bytes.
    """
    built = docs.sparkSession.sparkContext.broadcast(build(read_pieces(vocabulary) if pieces is None else pieces))
    start = mark.encode()

    def work(texts):
        return counts(texts, built.value, start)

    return per_text(docs, work, "n_words long, n_pieces long", id_col=id_col, text_col=text_col)
