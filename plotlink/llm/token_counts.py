"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at a position; dynamic
programming carries the best score and the piece count, never the pieces. Ties follow the public
unigram tokenizer: of equal scores for one end the earliest start wins, an unknown character costs
the lowest score less 10 and counts one token for each byte (byte fallback). No piece has a space
mark behind another character, so texts fall apart before such marks, exactly; parts are memoised.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; very long words
are processed in time linear in their length; an empty table gives no rows."""

import os

import pandas as pd
from pyspark.sql import DataFrame

from plotlink.llm.common import id_and_text, pages, per_worker

SPACE = "▁"
UNKNOWN_COST = 10.0
KEPT_PARTS, KEPT_CHARS = 300_000, 48


def read_vocabulary(path: str) -> list:
    """(piece, score) of a sentencepiece file, in the order of its ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts tokens of one text after another; built once for each worker and vocabulary."""

    def __init__(self, vocabulary: list):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_COST
        self.in_bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))  # else a run of unknown characters is one token
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.kept = {}

    def part(self, text: str) -> tuple:
        """(tokens, unknown characters, score) of a text that is not to be split."""
        n = len(text)
        ends = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(text):  # for each end the longest first, which starts earliest
            ends[last + 1].append(match)
        best, count, unknown, run = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, at, single = None, e - 1, False
            for length, score in ends[e]:
                s = best[e - length] + score
                if top is None or s > top:
                    top, at = s, e - length
                single |= length == 1
            count[e], unknown[e] = count[at] + 1, unknown[at]
            if not single and (top is None or best[e - 1] + self.unknown > top):
                top = best[e - 1] + self.unknown
                new = len(text[e - 1].encode("utf-8", "surrogatepass")) if self.in_bytes else int(not run[e - 1])
                count[e], unknown[e], run[e] = count[e - 1] + new, unknown[e - 1] + 1, True
            best[e] = top
        return count[n], unknown[n], best[n]

    def count(self, text: str) -> tuple:
        if not text:
            return 0, 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        if not self.splits:
            return self.part(text)
        kept, total, unknown, score, run = self.kept, 0, 0, 0.0, ""
        for x in text.split(SPACE)[1:]:
            run += SPACE
            if x:
                piece = run + x
                got = kept.get(piece)
                if got is None:
                    got = self.part(piece)
                    if len(piece) <= KEPT_CHARS:
                        if len(kept) >= KEPT_PARTS:
                            kept.clear()
                        kept[piece] = got
                total, unknown, score, run = total + got[0], unknown + got[1], score + got[2], ""
        if run:
            got = self.part(run)
            total, unknown, score = total + got[0], unknown + got[1], score + got[2]
        return total, unknown, score


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens, n_unknown and the score of the best segmentation."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(os.fspath(vocabulary_path)))  # a tokenizer's size
    name = f"unigram:{vocabulary_path}"

    def run(frames):
        counter = per_worker(name, lambda: Counter(vocabulary.value))
        for pdf in pages(frames):
            got = [counter.count(x) for x in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_chars": [len(x) for x in pdf["text"]],
                                "n_tokens": [g[0] for g in got], "n_unknown": [g[1] for g in got], "score": [g[2] for g in got]})

    return id_and_text(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_chars long, n_tokens long, n_unknown long, score double")
