"""Broken prompt and response pairs (problem 2).

Each answer is read against its prompt: what is left beside fences and figures, how it ends (truncation), refusals by an
Aho-Corasick automaton of what a speaker says who declines, with the task or the negation near by, how much of it a
suffix automaton of the prompt's words covers, and the language that its function words vote for. An answer has at most one defect, the first that applies in the order of DEFECTS.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import words

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")
RUN = 3
COVERED = 0.6
_FIGURE = re.compile(r"\\begin\{tikzpicture\}(?:\[[^\]]*\])?(.*?)\\end\{tikzpicture\}", re.S)
_FENCE = re.compile(r"```[A-Za-z]*")
_COMMENT = re.compile(r"(?<!\\)%([^\n]*)")
_LETTER = re.compile(r"[^\W_]")
_CLARIFY = re.compile(r"\W*clarify\s*:", re.I)
_CJK = re.compile(r"[㐀-鿿豈-﫿]")

_OTHER_SCRIPTS = (("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힯]")), ("ar", re.compile("[؀-ۿ]")), ("he", re.compile("[֐-׿]")), ("el", re.compile("[Ͱ-Ͽ]{2,}")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]")))


def _each(*parts: str) -> list[str]:
    """All phrases of one choice a part; choices are set apart by bars, an empty one leaves the part out."""
    return [" ".join(filter(None, x)) for x in product(*[p.split("|") for p in parts])]


#: How an answer declines, by grammar: a speaker who does not, cannot or may not, and (in `then`) what follows within
#: NEAR code points: the task or the negation. Lower case, straight apostrophes.
NEAR = 60
_TASKS = "assist|help|answer|draw|create|produce|generate|generating|construct|make|provide|providing|do|comply|fulfil|complete|render|sketch|build|give|respond|process|offer|carry|work|support|accept"
REFUSALS: tuple[tuple[list[str], list[str]], ...] = (
    (_each("i|we", "can't|cannot|can not|can no|could not|couldn't|won't|won't be|will not|will not be|do not|don't"), [" " + t for t in _TASKS.split("|")]),
    (_each("i am|i'm|we are|we're", "unable to|not able to|not in a position to|not allowed to|not permitted to|not willing to|not going to"), []),
    (_each("i|we", "must|have to|need to|will have to|am going to have to", "decline|refuse|pass|reject"), []),
    (_each("i|we", "decline to|refuse to|would rather not|'d rather not|prefer not to") + _each("i'd|we'd", "rather not|prefer not to"), []),
    (_each("isn't|is not|is nothing|not", "something", "i|we", "can|could|may"), []),
    (_each("not possible for", "me|us") + _each("beyond|outside|outside of", "my abilities|my ability|my capabilities|my scope|what i|what we"), []),
    (_each("my|our", "guidelines|rules|policy|policies|instructions"), [" keep", " prevent", " stop", " forbid", " prohibit", " do not", " don't", " bar"]),
    (_each("no", "figure|drawing|picture|diagram|sketch|answer|image", "will be|can be|is"), [" provided", " given", " produced", " drawn", " made", " created"]),
    (_each("kann ich|ich kann|darf ich|ich darf|möchte ich|ich möchte|werde ich|ich werde|bin ich|ich bin|konnte ich|ich konnte"), [" nicht", " keine"]),
    (_each("muss ich|ich muss", "|leider|das|dies", "ablehnen") + ["tut mir leid", "ich lehne"], []),
    (_each("je ne", "peux|puis|pourrai|saurais|suis pas en mesure|suis pas capable|veux|dois") + _each("je", "dois refuser|dois décliner|refuse|regrette|suis désolé") + ["désolé", "dépasse ce que je", "dépasse mes"], []),
    (_each("no", "|la|lo|las|los|te|le|se lo|me es", "puedo|podré|podría|posible") + _each("debo|tengo que", "rechazar|declinar|negarme") + ["lo siento", "me niego", "no soy capaz"], []),
    (["non posso", "non sono in grado", "mi dispiace", "devo rifiutare", "não posso", "não consigo", "lamento", "devo recusar", "não sou capaz"], []),
    (_each("ik kan|kan ik|ik mag|mag ik|ik wil|wil ik"), [" niet", " geen"]),
    (_each("не", "могу|смогу|в состоянии|имею права|буду") + _each("вынужден|вынуждена", "отказать|отказаться") + ["к сожалению", "извините", "простите"], []),
    (_each("nie", "mogę|potrafię|jestem w stanie|wolno mi") + ["niestety", "przepraszam", "muszę odmówić"], []),
    (["抱歉", "对不起", "无法", "我不能", "不能为", "不能帮", "不便"], []),
)

#: Common function words; a word of several languages votes for each of them in part.
STOPWORDS = {
    "en": "the of and is to at with from by on that its it are which has be for this both whose through until if so not there we our you as into over then here out up down its between when same in an or was were but their they each other one after before let i",
    "de": "der die das und ist mit von bei dem den des ein eine einen einer um nach auf wird dann danach wir durch zuerst sich hat zu oder nicht im ich es an in für auch aus als so wie sind am zum zur",
    "fr": "le la les et est avec du de dans sur une un par au aux pour se on qui que ensuite puis ne pas je cette ce son sa des il elle en à où jusqu d l",
    "es": "el la los las y con del de por una un se que alrededor hasta hacia para sobre primero después en al su es lo no como entre mediante desde",
    "it": "il lo la gli le e di con del della per una un si che su nel nella è al alla da poi sono non come tra dal",
    "pt": "o a os as e com do da dos das por uma um se que para em no na é ao à depois não como entre pelo pela",
    "nl": "de het een en van met door is op te aan dat die naar om voor niet dan zijn bij uit ook als tot",
    "sv": "och en ett är med av på som till den det för i att om från genom sedan inte vid",
    "cs": "a je s ze na do se že pro podle pak nebo bod v k o po jsou jako který není",
    "pl": "i w z na do po się aby oraz od że jest nie za przez który która które dla jak potem o to tego wokół względem pod nad",
    "ru": "и в на с к по из от за до что это не а или для как то вокруг через между потом сначала относительно я при",
    "uk": "і в на з до по та що це не або для як від через між потім є й у",
}
_VOTES: dict[str, list[str]] = {}
for _lang, _list in STOPWORDS.items():
    for _w in set(_list.split()):
        _VOTES.setdefault(_w, []).append(_lang)
_TOKEN = re.compile(r"[^\W\d_]+")
#: Votes by which the first language must lead the second.
LEAD = 0.5


def refusal_automaton() -> ahocorasick.Automaton:
    """Finds the openings of refusals; each knows what must follow."""
    automaton = ahocorasick.Automaton()
    for openings, then in REFUSALS:
        for phrase in openings:
            automaton.add_word(phrase, (len(phrase), then))
    automaton.make_automaton()
    return automaton


class SuffixAutomaton:
    """All runs of a list of tokens; each state knows where its longest run first ends."""

    __slots__ = ("next", "link", "size", "first")

    def __init__(self, tokens: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        last = 0
        for at, t in enumerate(tokens):
            now = self._state(self.size[last] + 1, at)
            p = last
            while p >= 0 and t not in self.next[p]:
                self.next[p][t] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.next[p][t]
                if self.size[p] + 1 == self.size[q]:
                    self.link[now] = q
                else:
                    twin = self._state(self.size[p] + 1, self.first[q])
                    self.next[twin] = dict(self.next[q])
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(t) == q:
                        self.next[p][t] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now

    def _state(self, size: int, first: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        self.first.append(first)
        return len(self.size) - 1

    def coverage(self, tokens: list[str], n: int, run: int = RUN) -> tuple[float, float]:
        """The shares of the given tokens, and of the automaton's own n tokens, within common runs of `run` or more."""
        mine, own = bytearray(len(tokens)), bytearray(n)
        state = length = 0
        for at, t in enumerate(tokens):
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if t in self.next[state]:
                state = self.next[state][t]
                length += 1
            if length >= run:
                mine[at - length + 1 : at + 1] = b"\1" * length
                end = self.first[state]
                own[end - length + 1 : end + 1] = b"\1" * length
        return sum(mine) / max(1, len(tokens)), sum(own) / max(1, n)


def tokens(text: str) -> list[str]:
    """Words, each Chinese character on its own."""
    found = words(text)
    if _CJK.search(text):
        return [x for w in found for x in (_CJK.sub(lambda m: f" {m[0]} ", w).split())]
    return found


def prose(text: str) -> str:
    """What is neither figure code nor fence; comments count."""
    if "\\" not in text and "```" not in text:
        return text
    parts, at = [], 0
    for m in _FIGURE.finditer(text):
        parts += [text[at : m.start()], *_COMMENT.findall(m[1])]
        at = m.end()
    parts.append(text[at:])
    return _FENCE.sub(" ", "\n".join(parts))


def language(text: str, least: float = 1.5) -> str | None:
    """The language most function words vote for, or None where it has fewer than `least` votes or leads by less than
    LEAD. Scripts of one language vote by their characters."""
    votes: dict[str, float] = {}
    if not text.isascii():
        votes = {lang: n for lang, rx in (("zh", _CJK), *_OTHER_SCRIPTS) if (n := len(rx.findall(text)))}
        if "ja" in votes:
            votes["ja"] += votes.pop("zh", 0)
    for t in _TOKEN.findall(text):
        if len(t) == 1 and t.isupper():
            continue
        langs = _VOTES.get(t.lower(), ())
        for lang in langs:
            votes[lang] = votes.get(lang, 0) + 1 / len(langs)
    if not votes:
        return None
    (best, most), *rest = sorted(votes.items(), key=lambda v: -v[1])[:2]
    return best if most >= least and most - (rest[0][1] if rest else 0) >= LEAD else None


class Judge:
    """Defects of one answer, but for its ending."""

    def __init__(self) -> None:
        self.refusals = refusal_automaton()

    def empty(self, text: str | None) -> bool:
        if not text:
            return True
        bare = _FIGURE.sub(lambda m: m[0] if _LETTER.search(m[1]) else " ", text)
        return not _LETTER.search(_FENCE.sub(" ", bare))

    def refuses(self, text: str) -> bool:
        plain = " ".join(unicodedata.normalize("NFKC", text).lower().replace("’", "'").split())
        for end, (size, then) in self.refusals.iter(plain):
            start = end + 1 - size
            if start and plain[start - 1].isalnum() and not _CJK.match(plain[start]):
                continue
            if not then or any(plain.find(word, end + 1, end + 1 + NEAR) >= 0 for word in then):
                return True
        return False

    def copies(self, prompt: str, text: str) -> bool:
        own, mine = tokens(prompt), tokens(text)
        if not own or not mine:
            return False
        if len(own) < RUN or len(mine) < RUN:
            return own == mine
        answer, given = SuffixAutomaton(own).coverage(mine, len(own))
        return answer >= COVERED and given >= COVERED

    def defect(self, prompt: str, text: str | None, cut: bool) -> str | None:
        if self.empty(text):
            return "empty"
        if cut:
            return "truncated"
        said = prose(text)
        figure = any(_LETTER.search(_COMMENT.sub("", m[1])) for m in _FIGURE.finditer(text))  # comments draw nothing
        if not figure and not _CLARIFY.match(text):
            if self.refuses(said):
                return "refusal"
            if self.copies(prompt, said):
                return "copy"
        if not _LETTER.search(said):
            return None
        answer = language(said)
        asked = language(prompt, 0.5) if answer else None
        return "language" if answer and asked and answer != asked else None


def defective_pairs(prompts: DataFrame, prompt_id: str, prompt_text: str, answers: DataFrame, answer_id: str, answer_text: str, cut: DataFrame) -> DataFrame:
    """(answer id, defect) of the defective answers. cut: (answer id) of the truncated ones.

    answers without prompt id or without a non-blank prompt are no pairs; a prompt or answer that comes twice counts
    once; clashing names in the two tables do no harm.
    """
    asked = prompts.select(F.col(prompt_id).alias("p"), F.col(prompt_text).alias("prompt")).filter(r"p is not null and prompt rlike '\\S'").groupBy("p").agg(F.max("prompt").alias("prompt"))
    given = answers.select(F.col(prompt_id).alias("p"), F.col(answer_id).cast("long").alias("a"), F.col(answer_text).alias("text")).filter("p is not null and a is not null")
    rows = given.join(cut.select(F.col(answer_id).alias("a")).distinct().withColumn("cut", F.lit(True)), "a", "left").join(asked, "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in batches:
            out = [(a, d) for a, prompt, text, c in zip(*(c.to_pylist() for c in batch.columns)) if (d := judge.defect(prompt, text, bool(c)))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string()))], [answer_id, "defect"])

    return rows.select("a", "prompt", "text", "cut").mapInArrow(run, f"{answer_id} long, defect string").dropDuplicates([answer_id])

