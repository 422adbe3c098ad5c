"""Flag defective answers: empty, truncated, refused, copied, in another language.

Sentences are scored for refusal by a linear model on hashed n-grams; each pair
of question and answer is scored for all defects by a multi-label linear model
on hashed n-grams of the answer's end and features of the pair.  Both learn from
real pairs that were cut, copied, swapped, refused or emptied on purpose; limits
are set on pairs that were held out.  Texts are scored by batches: chunks between
blanks are looked up once, and n-grams, languages and scores of a whole batch are
a few numpy passes.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import languages, refusals
from .lookalikes import UNSEEN

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
#: Pairs that the models are fitted to at most (one of each class of hashes of conversations), and characters of each text: the bound of the fit.
SAMPLE_PAIRS, SAMPLE_CHARS = 1200, 20_000
#: Turns of one conversation that are put in order in one task.
TURN_BLOCK = 512
SENT_BITS, PAIR_BITS = 17, 12
#: Made-up refusals of each language that the refusal model is fitted to.
MADE_REFUSALS = 900
#: Sentences of each language's texts that count as no refusals.
PROSE_SENTENCES = 200
#: Chunks, questions and sentences that a worker remembers at most, and pairs scored at a time.
REMEMBERED, BATCH_PAIRS = 100_000, 2048
#: Characters of an answer's end whose n-grams the pair model sees.
END_CHARS = 80

#: How message types name a human and an AI, in lower case.
HUMAN, AI = ("humanmessage", "human", "user"), ("aimessage", "ai", "assistant")
#: Stand-ins for nothing.
NOTHING = {"n/a", "na", "none", "null", "nil", "nan", "undefined", "no content", "no answer", "no response", "empty", "blank", "tbd", "todo", "없음", "내용 없음", "なし", "該当なし", "leer", "keine", "kein inhalt", "vide", "aucun", "néant", "vacío", "ninguno", "sin contenido", "vazio", "nenhum", "sem conteúdo"}
#: What languages are called in each of them.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés inglês 영어 英語",
    "ko": "korean koreanisch coréen coreano 한국어 韓国語",
    "de": "german deutsch allemand alemán alemão 독일어 ドイツ語",
    "fr": "french französisch français francés francês 프랑스어 フランス語",
    "es": "spanish spanisch espagnol español espanhol 스페인어 スペイン語",
    "ja": "japanese japanisch japonais japonés japonês 일본어 日本語",
    "pt": "portuguese portugiesisch portugais portugués português 포르투갈어 ポルトガル語",
}
#: Words before a question that is only said again.
ECHO = {
    "en": ["You wrote: ", "You said: ", "You want to know: ", "Again: ", "Your message reads: ", "The request is as follows. "],
    "de": ["Sie schrieben: ", "Sie sagten: ", "Sie wollen wissen: ", "Noch einmal: ", "Ihre Nachricht lautet: ", "Es geht um Folgendes. "],
    "fr": ["Vous écrivez : ", "Vous dites : ", "Vous voulez savoir : ", "Encore : ", "Votre message dit ceci : ", "La demande est la suivante. "],
    "es": ["Usted escribió: ", "Usted dijo: ", "Quiere saber: ", "Otra vez: ", "Su mensaje dice así: ", "La consulta es la siguiente. "],
    "pt": ["Você escreveu: ", "Você disse: ", "Quer saber: ", "De novo: ", "Sua mensagem diz assim: ", "O pedido é o seguinte. "],
    "ko": ["작성하신 글: ", "말씀하신 것: ", "알고 싶으신 것: ", "다시 적으면 ", "보내신 글은 아래와 같습니다. ", "요청은 이렇습니다. "],
    "ja": ["お書きの内容: ", "おっしゃったこと: ", "知りたいこと: ", "もう一度: ", "いただいた文面は以下の通りです。", "ご依頼はこうです。"],
}

_UNSEEN = re.compile("[" + "".join(f"\\U{p:08x}" for p in UNSEEN) + "\\x00-\\x08\\x0e-\\x1f]")
_TAG, _WORD, _RUN, _SIGN, _NAME = re.compile(r"<[^<>]{0,200}>"), re.compile(r"[^\W_]+"), re.compile(r"[!-~]+"), re.compile(r"[\d/\\_]"), re.compile(r"\b[A-Z]{2,}(?:-[A-Z]+)*\b|\b[A-Z][a-z]+[A-Z]\w*\b")
_PART = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|#")
_INNER = re.compile(r"(?<=\w)[^\w\s](?=\w)")
_ITEM = re.compile(r"\s*(?:\d{1,3}[.)]|[-*•])\s*")
_COMMAND = re.compile(r"^(?:\$ )?[a-z][\w.-]*(?: (?:-{1,2}[\w-]+|[\w./\\:-]+)){0,5}$")
_WIDE, _HANGUL, _KANA, _LETTER = re.compile(r"[぀-ヿ㐀-鿿가-힣]"), re.compile(r"[가-힣]"), re.compile(r"[぀-ヿ]"), re.compile(r"[^\W\d_]")
_NAMES = {name: code for code, names in LANGUAGE_NAMES.items() for name in names.split()}
_NAMED = re.compile("|".join(sorted(_NAMES, key=len, reverse=True)))
#: Signs that end a sentence, and signs that may follow them.
ENDS, CLOSERS = ".!?。！？…", "\"”’»」』)*_`"


def plain(text: str | None) -> str:
    """What there is to read: no markup, no signs that cannot be seen."""
    if not text:
        return ""
    out = _TAG.sub(" ", text).replace("&nbsp;", " ") if "<" in text or "&" in text else text
    return _UNSEEN.sub("", out).strip()


def is_empty(text: str | None) -> bool:
    body = plain(text).casefold().strip("()[]{}<>\"'*_-.。…—– \n\t ")
    return not _WORD.search(body) or body in NOTHING


def _coded(text: str) -> str:
    """A text in which ``#`` stands for codes and names of programs."""
    if _SIGN.search(text):
        text = _RUN.sub(lambda m: "#" if _SIGN.search(m[0]) else m[0], text)
    return _NAME.sub("#", text)


def _masked(sentence: str) -> str:
    return " ".join(_coded(sentence).casefold().split())


def _sentences(text: str) -> list[str]:
    return [text[a:b] for a, b in languages.sentences(text)]


def _mostly_wide(text: str) -> bool:
    return not text.isascii() and len(_WIDE.findall(text)) > 0.3 * len(text)


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _runs(tokens: np.ndarray, owner: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, hash)`` of all runs of so many tokens that have one owner."""
    owners, keys, run = [], [], np.zeros(len(tokens), np.uint64)
    for n in range(1, max(sizes) + 1):
        end = len(tokens) - n + 1
        if end <= 0:
            break
        run = (run[:end] + np.uint64(n)) * _A ^ tokens[n - 1 :] * _B
        if n in sizes:
            whole = owner[:end] == owner[n - 1 :]
            key = run[whole]
            key = (key ^ key >> np.uint64(29)) * _C
            owners.append(owner[:end][whole])
            keys.append(key ^ key >> np.uint64(32))
    return (np.concatenate(owners), np.concatenate(keys)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


@dataclass
class Rows:
    """Sparse binary rows: for each entry its row and its column, no column twice in a row."""

    owner: np.ndarray
    at: np.ndarray
    count: int

    def norm(self) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(np.bincount(self.owner, minlength=self.count), 1))


class Chunks:
    """Chunks between blanks: hashes of their masked words, their plain words, and what they say about the language."""

    def __init__(self, speech: tuple[dict[str, bytes], dict[str, list[str]]]) -> None:
        dictionaries, scripts = speech
        self.scripts, self.langs = scripts, scripts.get("latin", [])
        counts = [Counter(_PART.findall(dictionaries[c].decode("utf-8", "ignore"))) for c in self.langs]
        self.words = self._odds(counts)
        self.prose = [x for c in sorted(dictionaries) for x in dictionaries[c].decode("utf-8", "ignore").split("\n")[:PROSE_SENTENCES] if x.strip()]
        grams = [Counter() for _ in counts]
        for by, words in zip(grams, counts):
            for w, n in words.items():
                for g in self._grams(w):
                    by[g] += n
        self.grams = self._odds(grams)
        self.seen: dict[str, tuple[tuple[int, ...], tuple[str, ...], int]] = {}
        self.table = np.zeros((1024, max(1, len(self.langs)) + 1))

    @staticmethod
    def _grams(word: str) -> list[str]:
        padded = f"^{word}$"
        return [padded[k : k + 3] for k in range(len(padded) - 2)]

    @staticmethod
    def _odds(counts: list[Counter]) -> dict[str, np.ndarray]:
        """Of each item how much likelier it is in a language than on the average, in natural logarithms."""
        keys = sorted(set().union(*counts)) if counts else []
        total = np.array([sum(c.values()) for c in counts], float)
        out = {}
        for k in keys:
            p = np.log((np.array([c[k] for c in counts]) + 0.2) / (total + 0.2 * len(keys) + 1))
            out[k] = np.clip(p - p.mean(), -3, 3)
        return out

    def _evidence(self, word: str) -> np.ndarray | None:
        if word in self.words:
            return self.words[word]
        known = [self.grams[g] for g in self._grams(word) if g in self.grams]
        return 0.5 * np.mean(known, 0) if known else None

    def __call__(self, chunk: str) -> tuple[tuple[int, ...], tuple[str, ...], int]:
        found = self.seen.get(chunk)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            masked = _PART.findall(_coded(chunk).casefold())
            row = len(self.seen)
            if row >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[row] = 0
            for w in masked:
                if w != "#" and _LETTER.match(w):
                    odds = self._evidence(w) if self.langs else None
                    self.table[row, -1] += 1
                    if odds is not None:
                        self.table[row, :-1] += odds
            found = self.seen[chunk] = (tuple(xxhash.xxh64_intdigest(w) for w in masked), tuple(_WORD.findall(_INNER.sub("", chunk.casefold()))), row)
        return found

    def rows(self, texts: list[str], bits: int) -> Rows:
        """Hashed words, pairs and triples of words of each text; of scripts without blanks between words, runs of 2 to 5 characters."""
        words: list[int] = []
        size, wide_points, wide_owner = np.zeros(len(texts), np.int64), [], []
        for k, text in enumerate(texts):
            if _mostly_wide(text):
                points = np.frombuffer("".join(_coded(text).casefold().split()).encode("utf-32-le", "replace"), np.uint32)
                wide_points.append(points)
                wide_owner.append(np.full(len(points), k))
                continue
            before = len(words)
            words.append(1)
            for chunk in text.split():
                words.extend(self(chunk)[0])
            words.append(2)
            size[k] = len(words) - before
        owner, keys = _runs(np.array(words, np.uint64), np.repeat(np.arange(len(texts)), size), (1, 2, 3))
        if wide_points:
            wide = _runs(np.concatenate(wide_points).astype(np.uint64), np.concatenate(wide_owner), (2, 3, 4, 5))
            owner, keys = np.concatenate([owner, wide[0]]), np.concatenate([keys, wide[1]])
        both = np.sort(owner.astype(np.uint64) << np.uint64(bits) | keys & np.uint64((1 << bits) - 1))
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        return Rows((both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64), len(texts))

    def languages(self, texts: list[str], chunks: list[list[int]]) -> list[tuple[str, float]]:
        """The language that most of each text is in, and how sure that is: by script, then by its words; ``chunks`` are their rows."""
        size = np.array([len(c) for c in chunks])
        sums = np.zeros((len(texts), self.table.shape[1]))
        filled = np.flatnonzero(size)
        if len(filled):
            sums[filled] = np.add.reduceat(self.table[np.concatenate([np.array(c, np.int64) for c in chunks if c])], (np.cumsum(size) - size)[filled])
        out = []
        for text, total in zip(texts, sums):
            wide = 0 if text.isascii() else len(_WIDE.findall(text))
            if wide >= 5 and wide >= 0.25 * len(_LETTER.findall(text)):
                hangul, kana = len(_HANGUL.findall(text)), len(_KANA.findall(text))
                script = "hangul" if 2 * hangul >= wide else "kana" if kana else "han"
                known = self.scripts.get(script, [])
                out.append((known[0], 1.0) if known and script != "han" else ("han", 0.5) if script == "han" and wide >= 12 else ("", 0.0))
                continue
            if total[-1] < 3 or len(self.langs) < 2:
                out.append((self.langs[0], 0.5) if total[-1] >= 3 and self.langs else ("", 0.0))
                continue
            order = np.argsort(total[:-1])
            margin = float(total[order[-1]] - total[order[-2]])
            out.append((self.langs[order[-1]], margin / (margin + 6)) if margin >= 2 else ("", 0.0))
        return out


class Linear:
    """Logistic regression on sparse binary rows, by full-batch gradient steps with momentum."""

    def __init__(self, bits: int) -> None:
        self.w, self.b = np.zeros(1 << bits), 0.0

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 4.0, decay: float = 1e-4) -> Linear:
        norm = rows.norm()
        weight = weight * np.where(y > 0, 0.5 / max(1, weight[y > 0].sum()), 0.5 / max(1, weight[y <= 0].sum()))
        speed_w, speed_b = np.zeros_like(self.w), 0.0
        for _ in range(steps):
            gradient = (1 / (1 + np.exp(-self._z(rows, norm).clip(-30, 30))) - y) * weight
            speed_w = 0.9 * speed_w - rate * (np.bincount(rows.at, weights=(gradient * norm)[rows.owner], minlength=len(self.w)) + decay * self.w)
            speed_b = 0.9 * speed_b - rate * 0.2 * gradient.sum()
            self.w, self.b = self.w + speed_w, self.b + speed_b
        return self

    def _z(self, rows: Rows, norm: np.ndarray) -> np.ndarray:
        return np.bincount(rows.owner, weights=self.w[rows.at], minlength=rows.count) * norm + self.b

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-self._z(rows, rows.norm()).clip(-30, 30)))


DENSE = (
    "empty", "letters", "tail_end", "tail_ellipsis", "tail_item", "tail_comma", "tail_word", "open_fence", "command", "wide",
    "answer_in_question", "question_in_answer", "left_words", "left_any", "length_ratio", "whole_question",
    "refusal_share", "refusal_max", "refusal_first", "other_sentences", "any_refusal_all",
    "language_differs", "language_asked", "language_sure", "no_language",
)


@dataclass
class Asked:
    """What is remembered of a question."""

    words: list[str]
    wide_words: list[str]
    known: Counter
    wide_known: Counter
    language: tuple[str, float]
    wanted: set[str]


def _bigrams(text: str) -> list[str]:
    letters = [c for c in text.casefold() if c.isalnum()]
    return [a + b for a, b in zip(letters, letters[1:])] or letters


class Features:
    """Features of pairs, given the texts of languages and the model of refusals."""

    def __init__(self, speech: tuple[dict[str, bytes], dict[str, list[str]]] | Chunks, refusal: Linear | None = None, excuse: Linear | None = None) -> None:
        self.chunks, self.refusal, self.excuse = speech if isinstance(speech, Chunks) else Chunks(speech), refusal, excuse
        self.scores: dict[str, tuple[float, float]] = {}
        self.questions: dict[str, Asked] = {}

    def refused(self, sentences: list[str]) -> list[tuple[float, float]]:
        """How much each sentence sounds like a refusal, and like an excuse before an answer; equal sentences are scored once."""
        if len(self.scores) > REMEMBERED:
            self.scores.clear()
        new = [s for s in dict.fromkeys(sentences) if s not in self.scores]
        if new:
            rows = self.chunks.rows(new, SENT_BITS)
            self.scores.update(zip(new, zip(self.refusal.score(rows).tolist(), self.excuse.score(rows).tolist())))
        return [self.scores[s] for s in sentences]

    def _words(self, text: str) -> tuple[list[str], list[int]]:
        words, rows = [], []
        for chunk in text.split():
            _, plain_words, row = self.chunks(chunk)
            words += plain_words
            rows.append(row)
        return words, rows

    def _ask(self, questions: list[str]) -> None:
        if len(self.questions) > REMEMBERED // 4:
            self.questions.clear()
        new = [q for q in dict.fromkeys(questions) if q not in self.questions]
        if len(self.chunks.seen) > REMEMBERED // 2:
            self.chunks.seen.clear()
        asked = [plain(q) for q in new]
        found = [self._words(q) for q in asked]
        for q, text, (words, _), language in zip(new, asked, found, self.chunks.languages(asked, [r for _, r in found])):
            low = text.casefold()
            wide = [] if text.isascii() else _bigrams(text)
            self.questions[q] = Asked(words, wide, Counter(words), Counter(wide), language, {_NAMES[n] for n in _NAMED.findall(low)})

    def dense(self, questions: list[str], answers: list[str | None]) -> np.ndarray:
        self._ask(questions)
        bodies = [plain(a) for a in answers]
        found = [self._words(b) for b in bodies]
        spoken = self.chunks.languages(bodies, [r for _, r in found])
        parts = [_sentences(b) for b in bodies]
        flat = self.refused([s for p in parts for s in p])
        out, at = np.zeros((len(bodies), len(DENSE))), 0
        for k, (question, answer, body, (words, _), mine, own) in enumerate(zip(questions, answers, bodies, found, spoken, parts)):
            asked = self.questions[question]
            out[k] = self._row(asked, question, answer, body, words, mine, [(r, 0 if e >= 0.5 else len(s)) for (r, e), s in zip(flat[at : at + len(own)], own)])
            at += len(own)
        return out

    def _row(self, asked: Asked, question: str, answer: str | None, body: str, words: list[str], mine: tuple[str, float], scores: list[tuple[float, int]]) -> tuple[float, ...]:
        last = body.rsplit("\n", 1)[-1].rstrip() if body else ""
        fences = body.count("```")
        said, known = asked.words, asked.known
        any_wide = not body.isascii() and bool(_WIDE.search(body))
        wide = any_wide and _mostly_wide(body)
        if wide:
            words, said, known = _bigrams(body), asked.wide_words or _bigrams(plain(question)), asked.wide_known or Counter(_bigrams(plain(question)))
        own = Counter(words)
        common = sum(min(n, known[w]) for w, n in own.items() if w in known)
        left = (len(words) - common) / (2.5 if wide else 1)
        total = sum(n for _, n in scores) or 1
        unlike = [n for r, n in scores if r < 0.5]
        stripped = last.rstrip(CLOSERS)
        closed = body.rstrip(CLOSERS.replace("*", "").replace("_", "").replace("`", "") + "]")
        ellipsis = closed.endswith("..") or closed.endswith("…")
        over = stripped[-1:] != "" and stripped[-1:] in ENDS
        command = len(body) < 80 and not over and bool(_COMMAND.match(body))
        lang, sure = ("", 0.0) if command else mine
        theirs, sure_asked = asked.language
        differs = bool(lang and theirs and lang != theirs)
        end, word_end = over and not ellipsis, last[-1:].isalnum()
        if fences and fences % 2 == 0 and body.endswith("```"):
            end, word_end = True, False
        hit = sum(w in known for w in own)
        whole = bool(said) and hit > 0.75 * len(own) and hit >= min(4, len(known)) and len(own) <= 1.25 * len(known) + (14 if wide else 4)
        return (
            is_empty(answer), min(1.0, len(words) / 60), end, ellipsis, bool(_ITEM.fullmatch(last)) if last else False, last[-1:] != "" and last[-1:] in ",;:、，", word_end, fences % 2 == 1, command, any_wide,
            common / max(1, len(words)), common / max(1, len(said)), min(1.0, left / 12), left > 6, min(3.0, len(words) / max(1, len(said))) / 3, whole,
            sum(n for r, n in scores if r >= 0.5) / total, max((r for r, _ in scores), default=0.0), scores[0][0] if scores else 0.0, min(1.0, len(unlike) / 4), bool(scores) and not any(n > 25 for n in unlike) and any(r >= 0.5 for r, _ in scores),
            differs and lang not in asked.wanted, lang in asked.wanted, min(sure, sure_asked) if differs else 0.0, not lang,
        )

    def hashed(self, answers: list[str | None]) -> Rows:
        return self.chunks.rows([plain(a)[-END_CHARS:] for a in answers], PAIR_BITS)


@dataclass
class Judge:
    """The fitted models: ``weights`` over dense and hashed features per defect, and the limits."""

    speech: tuple[dict[str, bytes], dict[str, list[str]]]
    refusal: Linear
    excuse: Linear
    weights: np.ndarray
    bias: np.ndarray
    limits: np.ndarray

    def defects(self, features: Features, questions: list[str], answers: list[str | None]) -> list[str | None]:
        out: list[str | None] = []
        for a in range(0, len(answers), BATCH_PAIRS):
            q, x = questions[a : a + BATCH_PAIRS], answers[a : a + BATCH_PAIRS]
            p = 1 / (1 + np.exp(-_logits(features.dense(q, x), features.hashed(x), self.weights, self.bias).clip(-30, 30)))
            over = p - self.limits
            best = (over / np.maximum(1e-6, 1 - self.limits)).argmax(1)
            out += [DEFECTS[k] if row[k] >= 0 else None for row, k in zip(over, best)]
        return out

    def defect(self, features: Features, question: str, answer: str | None) -> str | None:
        return self.defects(features, [question], [answer])[0]


def _turns(messages: DataFrame) -> DataFrame:
    """Human and AI messages, one of each turn: of several contents the longest."""
    kind = F.lower(F.trim("type"))
    rows = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.when(kind.isin(*HUMAN), "h").when(kind.isin(*AI), "a").alias("_kind"), "content")
    return rows.where("_kind is not null").groupBy("conv_id", "turn", "_kind").agg(F.max_by("content", F.struct(F.length("content"), F.xxhash64("content"))).alias("content")).withColumn("_block", F.floor(F.col("turn") / TURN_BLOCK))


def paired(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, question, answer)``: each AI turn with the human message next before it.

    A message that was stored twice counts once; should a turn hold several
    contents, the longest counts.  Turns of a conversation are put in order in
    blocks, so no conversation is one task: the last human turn of a block is
    copied to the next block in which its conversation goes on.  AI messages
    without a human message before them, and rows without conversation or turn,
    give no pair.
    """
    rows = _turns(messages)
    # Which turn is carried into which block is found without the texts; conversations of one block carry none.
    kind = F.lower(F.trim("type"))
    light = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.floor(F.col("turn") / TURN_BLOCK).alias("_block"), kind.isin(*HUMAN).alias("_human"))
    ends = light.groupBy("conv_id", "_block").agg(F.max(F.when(F.col("_human"), F.col("turn"))).alias("_last"))
    before = F.last("_last", True).over(W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select("conv_id", "_block", before.alias("turn")).where("turn is not null")
    copies = rows.where("_kind = 'h'").drop("_block").join(carried, ["conv_id", "turn"]).select("conv_id", "turn", "_kind", "content", "_block", F.lit(False).alias("_own"))
    both = rows.withColumn("_own", F.lit(True)).unionByName(copies)
    human = F.when(F.col("_kind") == "h", F.struct("turn", "content"))
    inside = F.last(human, True).over(W.partitionBy("conv_id", "_block").orderBy("turn", F.desc("_kind")).rowsBetween(W.unboundedPreceding, -1))
    asked = both.withColumn("_q", inside).where("_kind = 'a' and _q is not null")
    return asked.select("conv_id", "turn", F.col("_q.content").alias("question"), F.col("content").alias("answer"))


def sample_pairs(messages: DataFrame) -> list[tuple[str, str]]:
    """At most ``SAMPLE_PAIRS`` pairs for the fit: of each class of hashes one conversation, and of that one pair.

    The conversations are chosen by their numbers alone, so only their messages are paired.
    """
    hashed = messages.where("conv_id is not null").select("conv_id", F.xxhash64("conv_id").alias("_h"))
    chosen = hashed.groupBy(F.pmod("_h", F.lit(SAMPLE_PAIRS)).alias("_class")).agg(F.min_by("conv_id", "_h").alias("conv_id")).select("conv_id")
    found = paired(messages.join(F.broadcast(chosen), "conv_id")).where("question is not null and answer is not null")
    short = found.select("conv_id", F.struct(F.xxhash64("conv_id", "turn").alias("h"), F.substring("question", 1, SAMPLE_CHARS).alias("q"), F.substring("answer", 1, SAMPLE_CHARS).alias("a")).alias("_r"))
    rows = short.groupBy("conv_id").agg(F.min("_r").alias("_r")).collect()
    return [(r["_r"]["q"], r["_r"]["a"]) for r in sorted(rows, key=lambda r: r["_r"]["h"])]


def _spoil(rng: np.random.Generator, question: str, answer: str, other: list[tuple[str, str]], lang: str, commands: list[str], families: tuple[str, ...] = refusals.FAMILIES) -> list[tuple[str, str, int]]:
    """Pairs made from a sound one: ``(question, answer, defect)``, -1 for none."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    out = [(question, answer, -1)]
    wide = bool(_WIDE.search(answer))
    cut = int(rng.integers(max(4, len(answer) // 5), max(5, len(answer) - 3)))
    body = answer[:cut].rstrip()
    if rng.random() < 0.6 and not wide and " " in body:
        body = body.rsplit(" ", 1)[0]
    if body and body.rstrip(CLOSERS)[-1:] not in ENDS:
        out.append((question, body + pick(["", "", "", ",", "...", "…", " -"]), DEFECTS.index("truncated")))
    lead = answer.split("\n")[0]
    out.append((question, lead + pick(["\n1. " + lead + "\n2.", "\n- ", "\n1.", "\n```\n$ " + pick(commands), "\n```\n" + pick(commands) + "\n" + lead]), DEFECTS.index("truncated")))
    out.append((question, lead + f"\n```\n$ {pick(commands)}\n```", -1))
    out.append((question, lead + f"\n1. {lead}\n2. {lead}", -1))
    out.append((question, pick(commands), -1))
    out += [(question, p, -1) for p in _sentences(lead)[:3] if p.rstrip(CLOSERS)[-1:] in ENDS]
    echo = pick(ECHO.get(lang, ECHO["en"]))
    said = pick([question, question.upper(), question.lower(), f'"{question}"', f"{question}\n", re.sub(r"[^\w\s/-]", "", question), question.replace(" ", "  "), echo + question, echo + question, f"> {question}", f"«{question}»", f"{question}\n{question}"])
    out.append((question, said, DEFECTS.index("copy")))
    out.append((question, f"{echo}{question}\n{answer}", -1))
    out.append((question, f"{question} {answer}", -1))
    if other:
        _, foreign = pick(other)
        out.append((question, foreign, DEFECTS.index("other_language")))
        code = pick(other)[0]
        asked = refusals.ASK_IN.get(lang, refusals.ASK_IN["en"])
        mate = [a for c, a in other if c == code]
        name = refusals.name_of(code, lang)
        out.append((f"{question} {asked.format(name)}", pick(mate), -1))
    no = lambda: refusals.draw(rng, lang, refusals.topic_of(rng, question), families)
    near = lambda excuse=False: refusals.draw_near(rng, lang, refusals.topic_of(rng, question), excuse)
    out.append((question, " ".join(no() for _ in range(int(rng.integers(1, 3)))), DEFECTS.index("refusal")))
    out.append((question, near() + " " + answer, -1))
    if rng.random() < 0.5:
        out.append((question, near(True) + " " + no(), DEFECTS.index("refusal")))
        out.append((question, pick(refusals.EMPTIES), DEFECTS.index("empty")))
    return out


def _sound(x: np.ndarray, question: str, answer: str) -> bool:
    """Whether a real pair shows no outward sign of a defect, so that it may stand for a sound one."""
    if is_empty(answer) or not question or len(answer) < 25:
        return False
    d = dict(zip(DENSE, x))
    ended = d["tail_end"] and not d["open_fence"] and not d["tail_item"]
    return bool(ended and d["answer_in_question"] < 0.6 and not d["language_differs"] and not d["no_language"] and d["refusal_share"] < 0.5)


def train(messages: DataFrame, labelled_texts: DataFrame, seed: int = 5) -> Judge:
    """Fit on at most ``SAMPLE_PAIRS`` pairs of ``messages``; ``labelled_texts`` (text, lang) teach the languages."""
    return fit(sample_pairs(messages), languages.train(labelled_texts), seed)


def fit_refusals(real: list[tuple[str, str]], chunks: Chunks, rng: np.random.Generator, families: tuple[str, ...] = refusals.FAMILIES, langs: tuple[str, ...] = refusals.LANGS) -> tuple[Linear, Linear]:
    """The models of sentences that refuse, and of those that excuse: made-up ones against what real answers and the texts of the languages say.

    Sentences of answers that look like made-up ones are left out the second time;
    but sentences that look refused and stand beside two or more plain ones belong
    to an answer.
    """
    parts = [_sentences(plain(a)) for _, a in real]
    said = sorted({_masked(s): s for p in parts for s in p}.values())
    topics = [q for q, _ in real] or ["#"]
    topic = lambda: refusals.topic_of(rng, topics[int(rng.integers(len(topics)))])
    made = sorted({refusals.draw(rng, lang, topic(), families) for lang in langs for _ in range(MADE_REFUSALS)})
    excuses = sorted({refusals.draw_near(rng, lang, topic(), True) for lang in langs for _ in range(MADE_REFUSALS // 4)})
    near = sorted({refusals.draw_near(rng, lang, topic()) for lang in langs for _ in range(MADE_REFUSALS // 4)} - set(excuses))
    texts = [*made, *excuses, *near, *chunks.prose, *said]
    rows, others, tail = chunks.rows(texts, SENT_BITS), np.ones(len(texts) - len(said)), len(texts) - len(said)
    is_refusal = np.r_[np.ones(len(made)), np.zeros(len(texts) - len(made))]
    is_excuse = np.r_[np.zeros(len(made)), np.ones(len(excuses)), np.zeros(len(texts) - len(made) - len(excuses))]
    first = Linear(SENT_BITS).fit(rows, is_refusal, np.ones(len(texts))).score(rows)[tail:]
    score = dict(zip(map(_masked, said), first))
    beside = set()
    for p in parts:
        keys = [_masked(s) for s in p]
        if sum(score[k] < 0.5 for k in keys) >= 2:
            beside.update(k for k in keys if score[k] >= 0.5)
    weight = np.r_[others, [10.0 if _masked(s) in beside else float(score[_masked(s)] < 0.5) for s in said]]
    refusal = Linear(SENT_BITS).fit(rows, is_refusal, weight)
    first = Linear(SENT_BITS).fit(rows, is_excuse, np.ones(len(texts)), steps=60).score(rows)[tail:]
    return refusal, Linear(SENT_BITS).fit(rows, is_excuse, np.r_[others, (first < 0.5).astype(float)], steps=60)


def fit(real: list[tuple[str, str]], speech, seed: int = 5, families: tuple[str, ...] = refusals.FAMILIES) -> Judge:
    rng = np.random.default_rng(seed)
    f = Features(speech)
    f.refusal, f.excuse = fit_refusals(real, f.chunks, rng, families)
    x = f.dense([q for q, _ in real], [a for _, a in real])
    sound = [pair for pair, row in zip(real, x) if _sound(row, *pair)]
    f._ask([q for q, _ in sound])
    lang_of = [f.questions[q].language[0] or "en" for q, _ in sound]
    by_lang: dict[str, list[str]] = {}
    for (_, a), lang in zip(sound, lang_of):
        by_lang.setdefault(lang, []).append(a)
    commands = sorted({m for _, a in real for m in re.findall(r"(?m)^\$ ([a-z].{2,60})$", a)}) or ["ls -l", "status --all", "check disk"]
    commands = sorted({c.rsplit(" ", 1)[0] if c.count(" ") > 1 else c for c in commands} | set(commands))
    # Pairs refused by rules of one half of the families are scored by a model that knows the other half, so that weights and limits count on unknown ways to refuse.
    rows: list[tuple[str, str, int]] = []
    x = np.zeros((0, len(DENSE)))
    for half in (families[::2], families[1::2]) if len(families) > 1 else (families,):
        unknown = tuple(z for z in families if z not in half) or families
        part: list[tuple[str, str, int]] = []
        for (q, a), lang in zip(sound[len(rows) > 0 :: 2], lang_of[len(rows) > 0 :: 2]):
            others = [(c, answers[int(rng.integers(len(answers)))]) for c, answers in sorted(by_lang.items()) if c != lang]
            part += _spoil(rng, q, a, others, lang, commands, half)
        if part:
            g = Features(f.chunks, fit_refusals(real, f.chunks, rng, unknown)[0], f.excuse)
            x, rows = np.concatenate([x, g.dense([q for q, _, _ in part], [a for _, a, _ in part])]), rows + part
    if not rows:
        raise ValueError("no sound pair to learn from")
    grams = f.hashed([a for _, a, _ in rows])
    label = np.array([k for _, _, k in rows])
    held = np.arange(len(rows)) % 5 == 0
    weights, bias = _multi(x, grams, label, ~held)
    p = 1 / (1 + np.exp(-_logits(x, grams, weights, bias).clip(-30, 30)))
    limits = np.array([_limit(p[held, k], label[held] == k) for k in range(len(DEFECTS))])
    return Judge(speech, f.refusal, f.excuse, weights, bias, limits)


def _hashed(grams: Rows, weights: np.ndarray) -> np.ndarray:
    """What the n-grams of each row add to the logits."""
    return np.stack([np.bincount(grams.owner, weights=weights[grams.at, k], minlength=grams.count) for k in range(weights.shape[1])], 1) * grams.norm()[:, None]


def _logits(x: np.ndarray, grams: Rows, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return x @ weights[: len(DENSE)] + bias + _hashed(grams, weights[len(DENSE) :])


def _multi(x: np.ndarray, grams: Rows, label: np.ndarray, use: np.ndarray, rounds: int = 24, steps: int = 8, rate: float = 2.0, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression per defect over dense and hashed features, fitted to the rows in ``use``.

    In each round the dense weights take ``steps`` steps, then the hashed ones,
    which are held back more, a single one.
    """
    dense, hashed, bias = np.zeros((len(DENSE), len(DEFECTS))), np.zeros((1 << PAIR_BITS, len(DEFECTS))), np.full(len(DEFECTS), -2.0)
    speed, speed_b, speed_h = np.zeros_like(dense), np.zeros_like(bias), np.zeros_like(hashed)
    y, weight, norm = (label[:, None] == np.arange(len(DEFECTS))).astype(float), use[:, None] / use.sum(), grams.norm()[:, None]
    for _ in range(rounds):
        fixed = _hashed(grams, hashed) if hashed.any() else np.zeros_like(y)
        for _ in range(steps):
            gradient = (1 / (1 + np.exp(-(x @ dense + bias + fixed).clip(-30, 30))) - y) * weight
            speed, speed_b = 0.9 * speed - rate * (x.T @ gradient + decay * dense), 0.9 * speed_b - rate * gradient.sum(0)
            dense, bias = dense + speed, bias + speed_b
        scaled = gradient * norm
        slope = np.stack([np.bincount(grams.at, weights=scaled[grams.owner, k], minlength=len(hashed)) for k in range(len(DEFECTS))], 1)
        speed_h = 0.5 * speed_h - rate * steps * (0.02 * slope + decay * hashed)
        hashed = hashed + speed_h
    return np.concatenate([dense, hashed]), bias


def _limit(p: np.ndarray, y: np.ndarray) -> float:
    """The limit with the best balance of precision and recall on pairs that were held out; of equally good ones a low one, as real defects are less plain than made-up ones."""
    grid = np.linspace(0.05, 0.95, 91)
    best = [2 * np.sum((p >= g) & y) / max(1, np.sum(p >= g) + y.sum()) for g in grid]
    good = np.flatnonzero(np.array(best) >= max(best) - 0.003)
    return float(grid[good[len(good) // 4]])


def flag_defects(pairs: DataFrame, judge: Judge) -> DataFrame:
    """``pairs`` with ``defect``: one of ``DEFECTS`` or null.  A null question counts as an empty one."""
    shared = pairs.sparkSession.sparkContext.broadcast(judge)

    def run(questions: pa.Array, answers: pa.Array) -> pa.Array:
        j = shared.value
        return pa.array(j.defects(_features(j), [q or "" for q in questions.to_pylist()], answers.to_pylist()), pa.string())

    return pairs.drop("defect").withColumn("defect", F.arrow_udf(run, "string")(F.col("question"), F.col("answer")))


_kept: list[tuple[Judge, Features]] = []


def _features(judge: Judge) -> Features:
    """The features of a judge, made once in each worker; the judge itself is kept, so another one is never taken for it."""
    if not _kept or _kept[0][0] is not judge:
        _kept[:] = [(judge, Features(judge.speech, judge.refusal, judge.excuse))]
    return _kept[0][1]
