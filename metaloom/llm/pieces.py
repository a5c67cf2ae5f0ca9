"""The vocabulary of a SentencePiece BPE model as arrays: where texts can be cut, which substrings are pieces.

No piece of a vocabulary may hold two characters side by side that stand side by side in no piece. So a position
between such characters is a token boundary in every segmentation of the text, whatever surrounds it: the text can be
cut there and its parts treated on their own. ``Vocabulary.cuts`` finds these *proven boundaries*.
"""

from __future__ import annotations

import functools

import numpy as np
import sentencepiece

SPACE = "▁"


class Vocabulary:
    """Characters are numbered as classes (0: in no piece), texts are handled in normalised form (spaces as U+2581)."""

    def __init__(self, path: str):
        self.path = path
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        texts, scores = [self.model.id_to_piece(i) for i in range(n)], np.array([self.model.get_score(i) for i in range(n)])
        self.byte_ids = np.full(256, -1, np.int64)
        self.width = np.ones(n, np.int64)  # characters that a token stands for; of a character given as bytes, the first counts
        words: list[tuple[str, int]] = []
        for i, text in enumerate(texts):
            if self.model.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_ids[value], self.width[i] = i, int(value & 0xC0 != 0x80)
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.width[i] = 0
            else:
                words.append((text, i))
                self.width[i] = len(text)
        points = sorted({ord(c) for text, _ in words for c in text})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[points] = np.arange(1, len(points) + 1)
        self.size = len(points) + 1
        self.beside = np.zeros((self.size, self.size), bool)
        for text, _ in words:
            c = self.classes[[ord(x) for x in text]]
            self.beside[c[:-1], c[1:]] = True
        self.longest = max(len(text) for text, _ in words)
        self.words, self.scores = words, scores
        self.space = int(self.classes[ord(SPACE)])

    def normalised(self, text: str) -> np.ndarray:
        """Code points with the leading space that the model adds; an empty text stays empty."""
        return points(SPACE + text.replace(" ", SPACE)) if text else np.zeros(0, np.uint32)

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Positions 1 .. len - 1 that are proven boundaries."""
        c = self.classes[codes]
        return np.flatnonzero(~self.beside[c[:-1], c[1:]]) + 1


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once in each Python worker."""
    return Vocabulary(path)
