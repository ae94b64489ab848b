"""Template residue, filler, error pages and script notices standing in the place of content.

Labelled exemplars are kept in an inverted index from term to exemplar. Terms are words, folded to concepts
where wordings vary, and structures: skeletons of unfilled slots, status and error numbers, places in program
code, identifiers. Passage windows of a document (neighbouring lines, also across cues, as long as exemplars are)
retrieve the exemplars they share terms with and are scored by TF-IDF containment both ways: how much of the best
exemplar the window holds, and how much of the window the exemplars it holds account for. Talk about such
things holds an exemplar too, but most of its own words, names and questions are not accounted for.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exemplars import CONCEPTS, LOREM, TALK, labelled
from tidemark.llm.words import _BREAK_TAG, _LABEL, _TAG, _TIMES, folded

_SLOT_MARK, _STATUS, _ERRNO, _CODE, _ID, _ASK, _TURN, _QUOTED = (f"\x02{n}" for n in ("slot", "status", "errno", "code", "id", "ask", "turn", "quoted"))
_NAME = r"[A-Za-z][\w .-]*+"
#: Forms of slots that template languages leave when nothing fills them.
_SLOT = re.compile(
    "|".join(
        (
            r"\{\{\{?[^{}\n]*+\}\}\}?",  # {{name}} {{ name | upper }} {{#each names}}
            r"[$#%@]\{[^{}\n]*+\}",  # ${name} #{name}
            r"\{[%#][^{}%#\n]*+[%#]\}",  # {% name %}
            r"<%[=-]?[^<>%\n]*+%>",  # <%= name %>
            r"\[%[^\[\]%\n]*+%\]",  # [% name %]
            r"<\?(?:=|php)?[^<>?\n]*+\?>",  # <?= name ?>
            r"\[\[[^\[\]\n]*+\]\]",  # [[name]]
            rf"<<\s*{_NAME}>>",  # <<name>>
            r"\{(?:\d{1,2}|[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*)\}",  # {0} {name}
            r"@@[A-Za-z][\w ]*+@@",  # @@NAME@@
            r"##[A-Za-z][\w ]*+##",  # ##NAME##
            r"(?<!\w)__[A-Za-z]\w*?__(?!\w)",  # __NAME__
            r"(?<![\w%])%[A-Za-z]\w+%(?!\w)",  # %NAME%
            r"(?<![\w$])\$[A-Za-z]\w+\$(?!\w)",  # $name$
            r"(?<![\w:]):[A-Z][A-Z_]+:(?![\w:])",  # :NAME:
            rf"%\(\s*{_NAME}\)[sdif]",  # %(name)s
            r"(?<!\w)%(?:\d\$)?[sd](?!\w)",  # %s
            r"\[(?:[Il1|]N[S5]ERT|YOUR|ENTER|ADD|[Ii]nsert|[Yy]our|[Ee]nter) [^\[\]\n]++\]",  # [INSERT NAME HERE]
            r"<(?:your|insert|enter|YOUR|INSERT|ENTER) [^<>\n]++>",  # <your name here>
            r"\[[A-Z]+_[A-Z_]+\]|<[A-Z]+_[A-Z_]+>|\((?:your|insert) [^()\n]++ here\)",  # [FIRST_NAME]
        )
    ),
    re.ASCII,
)
#: Where a slot may begin; led by one set of characters, so a text without slots is passed over quickly.
_SIGIL = re.compile(
    r"[{@#_%$\[<:(](?:(?<=\{)[^\\]|(?<=@)[@{]|(?<=#)[#{]|(?<=_)_[A-Za-z]|(?<=%)[A-Za-z({\d]|(?<=\$)[A-Za-z{]|(?<=:)[A-Z]{2}"
    r"|(?<=\[)(?:[\[%]|[Il1|]N[S5]|YOUR|ENTER|ADD|[Ii]nsert |[Yy]our |[Ee]nter |[A-Z]+_)|(?<=<)(?:<|[%?]|your|insert|enter|YOUR|INSERT|ENTER|[A-Z]+_)|(?<=\()(?:your|insert) )"
)
_QUOTES = "\"'“”„‟«»‘’‚`´\u0093\u0094\u0091\u0092\u0084"
_DAMAGED_QUOTE = re.compile(r"(?:â\S{0,6}|Â\S{0,3}|\?|�)$")
_PLACE = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|io|tv)\b\S*|(?:/[\w.-]+){2,}", re.I)
_STATUS_NUMBER = re.compile(r"(?<![\w.,/])[45]\d\d(?![\w,/]|\.\d)")
#: What may be a status number once places, tags and underscores are gone; no part of a time.
_MAY_BE_STATUS = re.compile(r"[45](?<![^\W_][45])(?<![.,][45])\d\d(?![^\W_])")
_ERROR_NUMBER = re.compile(r"\b(?:error|code|fehler|erreur)\s*+(?:code|no\.?|number|[#:])?\s*+#?(?![45]\d\d\b)\d+\b", re.I)
_PROGRAM = re.compile(r"\bon line \d+|\bline \d+, in\b|(?<![\w/.-])(?:[\w/-]++\.)++(?:php|py|js|jsp|aspx?|cgi|rb|pl|java|cpp)\b|\b\w++\(\)|\b[A-Z][A-Za-z]*?(?:Error|Exception)\b|\b[A-Z]{4,}+\[HY\w*+\]")
_IDENTIFIER = re.compile(r"\b(?=\w*\d)(?=\w*[a-f])[0-9a-f]{8,}\b", re.I)
#: Numbers and identifiers; a word with one or two misread letters is none.
_NUMBER = re.compile(r"\b\d+\b|\b\w*\d\w*\d\w*\d\w*|\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", re.I)
_QUESTION = re.compile(r"\?(?=[\s\"'”»)]|$)")
_NAME_LIKE = re.compile(r"(?<=[a-z,] )[A-Z][a-z]+")
_KNOWN_WORDS = 1_000_000
_LEAST_SHARE = 0.0005
#: A slot weighs as many words that no text has; a question, a change of speaker or a quotation as half of one.
_SLOT_WEIGHT, _TALK_WEIGHT = 8.0, 0.5
#: Most that a word no exemplar has counts against its window, unless it is written as a name.
_FOREIGN = 4.0


@lru_cache(maxsize=1)
def _concepts() -> tuple[dict[str, str], dict[str, str], int]:
    """Concept of folded words, of folded beginnings of words, and the shortest of the latter."""
    whole, begins = {}, {}
    for line in CONCEPTS.strip().splitlines():
        name, *words = line.split()
        for w in words:
            for f in folded(w.rstrip("*")):
                (begins if w.endswith("*") else whole).setdefault(f, f"\x03{name}")
    return whole, begins, min(map(len, begins))


@lru_cache(maxsize=1)
def _talk() -> frozenset[str]:
    return frozenset(folded(TALK))


@lru_cache(maxsize=_KNOWN_WORDS)
def concept(word: str) -> str:
    """The concept of a folded word, or the word."""
    whole, begins, shortest = _concepts()
    if word in whole:
        return whole[word]
    return next((begins[word[:n]] for n in range(len(word), shortest - 1, -1) if word[:n] in begins), word)


def _quoted(text: str, start: int, end: int) -> bool:
    before, after = text[:start].rstrip(" "), text[end:].lstrip(" ")
    if before[-1:] and before[-1] in _QUOTES and (not after or after[0] in _QUOTES or after[0] in "â�?Â"):
        return True
    return bool(_DAMAGED_QUOTE.search(before[-8:]) and after[:1] in ("â", "Â", "�", "?", *_QUOTES))


def skeleton(slot: str) -> str:
    """The form of a slot, without its name; blocks and raw slots of the braces family count as its plain form."""
    slot = re.sub(r"^\{\{+[#/^>&!~]?", "{{", re.sub(r"\}\}+$", "}}", slot))
    return _SLOT_MARK + re.sub(r"\s*\w[\w .:|'-]*", "n", slot)


def terms(text: str) -> dict[str, bool]:
    """Terms of a window, each with whether it is written as a name."""
    out: dict[str, bool] = {}
    if _SIGIL.search(text):
        parts, at = [], 0
        for m in _SLOT.finditer(text):
            out[_QUOTED if _quoted(text, m.start(), m.end()) else skeleton(m[0])] = False
            parts.append(text[at : m.start()])
            at = m.end()
        text = " ".join([*parts, text[at:]])
    text = _PLACE.sub(" ", _TAG.sub("", text))
    for mark, pattern in ((_STATUS, _STATUS_NUMBER), (_ERRNO, _ERROR_NUMBER)):
        if pattern.search(text.replace("_", " ")):
            out[mark] = False
    for mark, pattern in ((_CODE, _PROGRAM), (_ID, _IDENTIFIER)):
        text, n = pattern.subn(" ", text)
        if n:
            out[mark] = False
    if _QUESTION.search(text):
        out[_ASK] = False
    if text.lstrip().startswith(("- ", "– ")):
        out[_TURN] = False
    names = {w for m in _NAME_LIKE.findall(text) for w in folded(m)}
    for w in folded(_NUMBER.sub(" ", text.replace("_", " "))):
        c = concept(w)
        out[c] = out.get(c, True) and w in names
    return out


def _spoken(line: str, known: frozenset[str]) -> str:
    """``line`` without its speaker label; ``TODO:`` or ``Error:`` of an exemplar is none."""
    label = _LABEL.match(line)
    return line[label.end() :].strip() if label and known.isdisjoint(map(concept, folded(label[0]))) else line.strip()


def cues(text: str, known: frozenset[str] = frozenset()) -> Iterator[list[str]]:
    """The lines of each cue, without numbers, times and speaker labels (but for ``known`` terms); pages as lines of their blocks."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "-->" in text:
        text = _TIMES.sub("\n", text)
    if "<" in text:
        text = _BREAK_TAG.sub("\n", text)
    for cue in re.split(r"\n[ \t]*\n", text):
        lines = [x for x in (_spoken(line, known) for line in cue.split("\n")) if x]
        if lines:
            yield lines


class Index:
    """Inverted index of exemplars: term -> exemplars, with inverse document frequencies of the corpus."""

    def __init__(self, frequency: dict[str, int], documents: int, held: float = 0.75, accounted: float = 0.65, exemplars: Sequence[tuple[str, str]] | None = None) -> None:
        self.held, self.accounted = held, accounted
        self.exemplars: list[tuple[str, str, frozenset[str]]] = []
        for kind, text in labelled() if exemplars is None else exemplars:
            found = frozenset(terms(text)) - {_ASK, _TURN, _QUOTED}
            if found:
                self.exemplars.append((kind, text, found))
        self.bag = len(self.exemplars)
        self.exemplars.append(("filler", "dummy paragraph", frozenset(folded(LOREM))))
        # A share of documents that no corpus, however large, takes a word below: weights are alike at every size.
        weight = lambda df: -math.log(df / max(documents, 1) * (1 - _LEAST_SHARE) + _LEAST_SHARE) + 0.1
        #: Words no exemplar has weigh as much as those no document has, but for the bound on what is foreign.
        self.other = weight(0)
        self.idf = {w: weight(frequency.get(w, 0)) for _, _, words in self.exemplars for w in words}
        self.idf |= {w: self.other * (_SLOT_WEIGHT if w.startswith(_SLOT_MARK) else 1.0) for w in self.idf if w.startswith("\x02")}
        self.mass = [sum(self.idf[w] for w in words) for _, _, words in self.exemplars]
        # Of the dummy paragraph a window holds a few words; any three that talk hardly uses suffice.
        rare = sorted(self.idf[w] for w in self.exemplars[self.bag][2] if frequency.get(w, 0) <= 0.02 * documents)
        self.mass[self.bag] = min(self.mass[self.bag], sum(rare[:3]))
        self.words = frozenset(self.idf)
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, (_, _, words) in enumerate(self.exemplars):
            for w in words:
                self.postings[w].append(i)
        #: Windows are as long as the longest exemplar, and half as long again.
        self.longest = max(len(text.split()) for _, text, _ in self.exemplars[: self.bag] or [("", "x", frozenset())]) * 3 // 2
        #: Terms of which a window must hold one to hold any exemplar to the part ``held``: of each exemplar the
        #: rarest, until what is left of it would not suffice. Nothing that could match lacks them.
        self.anchors = frozenset(w for i in range(len(self.exemplars)) for w in self._rarest(i))

    def _rarest(self, i: int) -> list[str]:
        # Identifiers last: the pre-screen of texts does not look for them.
        words = sorted(self.exemplars[i][2], key=lambda w: (w == _ID, -self.idf[w], w))
        left = sum(self.idf[w] for w in words)
        for n, w in enumerate(words):
            if left < (self.held - 1e-6) * self.mass[i]:
                return words[:n]
            left -= self.idf[w]
        return words

    @staticmethod
    def vocabulary(exemplars: Sequence[tuple[str, str]] | None = None) -> frozenset[str]:
        every = labelled() if exemplars is None else exemplars
        return frozenset(w for _, text in every for w in terms(text) if not w.startswith("\x02")) | frozenset(folded(LOREM))

    def against(self, term: str, name: bool) -> float:
        """What a term that no exemplar of the window accounts for weighs."""
        if term in (_ASK, _TURN, _QUOTED):
            return self.other * _TALK_WEIGHT
        if term in _talk():
            return self.other
        if term.startswith("\x02"):
            return self.other if term.startswith(_SLOT_MARK) else 0.0
        weight = self.idf.get(term, self.other)
        return weight if name else min(weight, _FOREIGN)

    def best(self, window: dict[str, bool]) -> tuple[float, float, int] | None:
        """(part of the exemplar held, part of the window accounted for, exemplar) if both reach their bounds."""
        # A status number alone may be a cue's number.
        if self.anchors.isdisjoint(window) or window.keys() <= {_STATUS}:
            return None
        shared: Counter[int] = Counter()
        for w in window.keys() & self.idf.keys():
            if w != _STATUS:
                for i in self.postings[w]:
                    shared[i] += self.idf[w]
        if _STATUS in window:
            # A number counts for the exemplars that have another term with the window.
            for i in shared.keys() & set(self.postings[_STATUS]):
                shared[i] += self.idf[_STATUS]
        part = {i: min(1.0, mass / self.mass[i]) for i, mass in shared.items()}
        top = max(part, key=lambda i: (part[i], self.mass[i], -i), default=None)
        if top is None or part[top] < self.held - 1e-9:
            return None
        # What the window holds a good part of accounts for its terms.
        known = frozenset().union(*(self.exemplars[i][2] for i, p in part.items() if p >= 0.4))
        mine = sum(self.idf[w] for w in window.keys() & known)
        cover = mine / (mine + sum(self.against(w, name) for w, name in window.items() if w not in known))
        return (part[top], cover, top) if cover >= self.accounted - 1e-9 else None

    def matches(self, lines: list[tuple[str, int]], useful: list[bool]) -> Iterator[tuple[str, tuple[float, float, int]]]:
        """Windows of neighbouring lines (each with its cue) that match, shortest first; none that holds a shorter one.

        A window begins and ends where it likes; it has no more words than the longest exemplar asks for, however
        many lines and cues they are spread over.
        """
        found: list[tuple[int, int]] = []
        own: dict[int, dict[str, bool]] = {}
        upto = [0]
        for line, _ in lines:
            upto.append(upto[-1] + len(line.split()))
        # A window needs a useful line; only starts from which one is near enough are tried.
        starts, near = [], len(lines)
        for i in range(len(lines) - 1, -1, -1):
            near = i if useful[i] else near
            if near < len(lines) and (near == i or upto[near + 1] - upto[i] <= self.longest):
                starts.append(i)
        starts, n = starts[::-1], 1
        while starts:
            starts = [i for i in starts if i + n <= len(lines) and (n == 1 or upto[i + n] - upto[i] <= self.longest) and not any(i <= a and b <= i + n for a, b in found)]
            for i in starts:
                if not any(useful[i : i + n]) or any(i <= a and b <= i + n for a, b in found):
                    continue
                window: dict[str, bool] = {}
                for k in range(i, i + n):
                    if k not in own:
                        own[k] = terms(lines[k][0])
                    for t, name in own[k].items():
                        window[t] = window.get(t, True) and name
                joined = "\n".join(line for line, _ in lines[i : i + n])
                if n > 1 and lines[i][1] == lines[i + n - 1][1] and _SIGIL.search(joined):
                    # A slot broken over lines of a cue.
                    window |= {t: False for t in terms(joined.replace("\n", " ")) if t.startswith("\x02")}
                match = self.best(window)
                if match:
                    found.append((i, i + n))
                    yield joined, match
            n += 1


class Vocabulary:
    """The exemplars' terms in a text. What a written word contributes is remembered, so a text costs a look-up for each of its distinct words."""

    def __init__(self, words: frozenset[str]) -> None:
        self.words, self.known = words, {}

    def of(self, text: str) -> set[str]:
        known, out = self.known, set()
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for token in set(text.split()):
            found = known.get(token)
            if found is None:
                if token[0].isdigit() and not any(map(str.isalpha, token)):
                    continue
                found = known[token] = self.words.intersection(map(concept, folded(_NUMBER.sub(" ", token.replace("_", " ")))))
            if found:
                out |= found
        return out


def has_slot(text: str) -> bool:
    return _SIGIL.search(text) is not None and _SLOT.search(text.replace("\n", " ")) is not None


#: What a place in program code, or an error's number, cannot do without; looked for before the patterns are.
_PROGRAM_SIGNS = ("line ", "()", "Error", "Exception", ".php", ".py", ".js", ".asp", ".cgi", ".rb", ".pl", ".java", ".cpp", "[HY")
_ERROR_SIGNS = ("error", "code", "fehler", "erreur")


def _structured(text: str) -> bool:
    """Whether a text may have a term that is no word (but for identifiers, which no exemplar rests on)."""
    if _MAY_BE_STATUS.search(text) or has_slot(text):
        return True
    if any(sign in text for sign in _PROGRAM_SIGNS) and _PROGRAM.search(text):
        return True
    low = text.lower()
    return any(sign in low for sign in _ERROR_SIGNS) and _ERROR_NUMBER.search(text) is not None


def residue_matches(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    exemplars: Sequence[tuple[str, str]] | None = None,
    held: float = 0.75,
    accounted: float = 0.65,
) -> DataFrame:
    """Documents with residue: ``doc_id, windows, kinds, exemplar, evidence``.

    windows: matching passages, none inside another; kinds: the sorted kinds found (slot, filler, error, notice);
    exemplar and evidence: of the first match. One row for each document row that has a match (repeated rows each
    give one), so an anti join on the id, or the rows absent here, are the documents to keep.

    exemplars: labelled texts ``(kind, text)``, a parameter that the driver holds (by default those of the module).
    A passage matches if it holds at least the part ``held`` of an exemplar's TF-IDF mass and the exemplars it holds
    account for at least the part ``accounted`` of its own; slots are terms like others.

    Document frequencies are counted over all documents before any is judged; only the terms of the
    exemplars, a fixed list, are counted, so what the driver gets and broadcasts does not grow. Whole
    texts are read. Null and empty texts have no residue; a null id is returned as null. Words in
    letters other than Latin take no part. Empty input, empty result.
    """
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(documents.dtypes)[doc_id]
    index = documents.sparkSession.sparkContext.broadcast(_fitted(source, exemplars, held, accounted))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = index.value
        seen = Vocabulary(known.anchors)
        for batch in batches:
            found = [(doc, *hit) for doc, t in zip(batch["doc_id"], batch["text"]) if (hit := _hit(known, seen, t))]
            yield pd.DataFrame(found, columns=["doc_id", "windows", "kinds", "exemplar", "evidence"])

    return source.mapInPandas(judge, f"doc_id {kind}, windows int, kinds array<string>, exemplar string, evidence string")


def _fitted(source: DataFrame, exemplars: Sequence[tuple[str, str]] | None, held: float, accounted: float) -> Index:
    """The index with document frequencies of all of ``source`` (``text``)."""
    vocabulary = Index.vocabulary(exemplars)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        seen = Vocabulary(vocabulary)
        rows = 0
        for batch in batches:
            for t in batch["text"]:
                rows += 1
                if t:
                    counts.update(seen.of(t))
        yield pd.DataFrame([("", rows), *counts.items()], columns=["word", "n"])

    counted = source.select("text").mapInPandas(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {r["word"]: int(r["n"]) for r in counted}
    total = frequency.pop("", 0)
    return Index(frequency, total, held, accounted, exemplars)


def _hit(known: Index, seen: Vocabulary, text: str | None) -> tuple[int, list[str], str, str] | None:
    """(windows, kinds, exemplar, evidence) of a text with residue."""
    if not text or not (seen.of(text) or _structured(text)):
        return None
    lines = [(line, k) for k, cue in enumerate(cues(text, known.words)) for line in cue]
    whole = defaultdict(list)
    for line, k in lines:
        whole[k].append(line)
    broken = {k for k, parts in whole.items() if len(parts) > 1 and has_slot(" ".join(parts))}
    useful = [k in broken or bool(seen.of(line)) or _structured(line) for line, k in lines]
    if not any(useful):
        return None
    found = list(known.matches(lines, useful))
    if not found:
        return None
    first = known.exemplars[found[0][1][2]]
    return len(found), sorted({known.exemplars[i][0] for _, (_, _, i) in found}), first[1], found[0][0]


def drop_residue(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", exemplars: Sequence[tuple[str, str]] | None = None, held: float = 0.75, accounted: float = 0.65) -> DataFrame:
    """The documents without residue, all columns, every row judged by its own text in the pass that reads it."""
    index = documents.sparkSession.sparkContext.broadcast(_fitted(documents.select(F.col(text).alias("text")), exemplars, held, accounted))

    @F.pandas_udf("boolean")
    def sound(texts: pd.Series) -> pd.Series:
        seen = Vocabulary(index.value.anchors)
        return pd.Series([_hit(index.value, seen, t) is None for t in texts], dtype=bool)

    return documents.where(sound(F.col(text)))
