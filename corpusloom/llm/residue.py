"""Template residue, filler, error pages and script notices in place of content.

Labelled exemplars are kept in an inverted index of their terms; words that say the same in such texts are one term (``SAME``).
A text is read in passage windows: its lines, up to three adjoining lines of a paragraph, the sentences of long lines, and what
stands between the delimiters of a slot. A window that shares an index term is compared with the exemplars it retrieves:
containment is the share of an exemplar's TF-IDF weight that the window holds, coverage the share of the window's weight that
the exemplars of that label explain. A window is residue if an exemplar is contained and its label covers it well, and better
than text that only speaks of such things. Document frequencies are counted over the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from corpusloom.llm.sketch import hashed_counts, lookup


@dataclass(frozen=True)
class Settings:
    df_bits: int = 20  # cells of the document frequencies (two rows)
    containment: float = 0.7
    coverage: float = 0.6
    sentence: float = 0.75  # coverage of a sentence within a longer line
    slot: float = 0.4  # coverage of what stands in a slot
    bag_terms: int = 3  # least distinct terms of a bag of filler words in a passage
    repeats: int = 5  # least repetitions of a passage's only word
    anchor_share: float = 0.05  # a term in a greater share of all texts retrieves nothing alone


# Words that say the same in such texts; a star stands for any ending.
SAME = {
    "js": "javascript* scripts ecmascript",
    "enable": "enabl* activ* aktiv* ativ* attiv* habilit* allow unblock switch* turn schalten включ*",
    "need": "need needs requir* must necessary nécessaire requis* erforderlich benötigt requiere necesita richiede vereist требуется необходим*",
    "off": "off disabled deactivated blocked désactivé* deaktiviert desactivado desativado uitgeschakeld отключен*",
    "not": "not cannot t no nicht keine non pas não не niet",
    "page": "page pages app application site website webpage document* file url resource link seite* página* pagina* sitio страниц* сайт",
    "browser": "browser* navigateur navegador браузер*",
    "found": "found find exist* located available disponible* verfügbar доступн* introuvable gefunden encontr* trouv* trova* gevonden найден* существует",
    "load": "load* display* show* open* render* reach* retrieve*",
    "error": "whoops error* erreur* fehler* erro ошибк* oops exception problem wrong",
    "deny": "denied forbidden unauthorized refusé* interdit* verweigert denegad* prohibid* negad* negat* geweigerd запрещ*",
    "access": "access accès zugriff* acceso acesso accesso toegang доступ* permission* authorized",
    "connect": "connect* connexion verbindung conexión establish*",
    "again": "again later retry reload refresh shortly soon",
    "expire": "expire* timeout timed abgelaufen expiré* expirad*",
    "insert": "insert* enter add fill type put write describe replace choose select provide einfügen eintragen insérer saisir inserir вставьте введите укажите",
    "field": "name* nombre title titel titre título date datum fecha address email phone company number signature summary description recipient customer client operator nom имя название дату",
    "own": "your you my our own ihr ihre votre su tu seu sua ваш*",
    "text": "text* content* paragraph copy contenu inhalt conteúdo текст",
    "place": "here hier ici aquí aqui qui здесь goes",
    "dummy": "placeholder dummy sample filler provisoire platzhalter blindtext relleno provisório",
}
#: Words without a bearing; they are no terms.
NEUTRAL = frozenset(
    "please sorry we re are is the a an of to in on this that these it be was were been has have had for with and or by at from as can could will would use using used "
    "bitte leider die der das diese dieser wurde ist im um zu sie en de la le les cette ce merci désolé por favor lo sentimos el los esta este o da do para se une un est "
    "do does doesn didn couldn wouldn isn aren what which were so but if there here's it's auf an bei mit von für nicht's aux au à sur dans du des una un al del con sin nella della il lo к с по из у о "
    "пожалуйста в и на для questa questo per deze om te".split()
)
_ONE = {w: f"={one}" for one, words in SAME.items() for w in words.split() if w[-1] != "*"}
_STEMS = [(w[:-1], f"={one}") for one, words in SAME.items() for w in words.split() if w[-1] == "*"]
_FIRST = {stem[:3] for stem, _ in _STEMS}


class _Same(dict):
    """The term of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> str:
        if len(self) > 1 << 18:
            self.clear()
        if word[0].isdigit():
            term = word if len(word) == 3 else "#"
        else:
            term = _ONE.get(word) or (next((one for stem, one in _STEMS if word.startswith(stem)), word) if word[:3] in _FIRST else word)
        self[word] = term
        return term


_term = _Same()


#: The term of a passage that is one word again and again, as typed to fill a page.
REPEATED = "⟨again and again⟩"

# Labelled exemplars.
NOTICES = """enable javascript | enable javascript to continue | enable javascript to view this page | you need to enable javascript to run this app | javascript is required | this site requires javascript to work properly
javascript is disabled in your browser please enable it | javascript seems to be switched off | your browser does not support javascript | scripts are blocked allow them and reload to see the page | javascript must be turned on
please turn on javascript and cookies in your browser | checking your browser before you enter cookies must be on | just a moment verifying that you are human | please verify you are not a robot complete the captcha | this app viewer works best with javascript enabled
veuillez activer javascript pour afficher cette page | javascript est désactivé dans votre navigateur | bitte aktivieren sie javascript um diese seite zu sehen | für diese seite wird javascript benötigt | active javascript para ver este sitio
este sitio necesita javascript | ative o javascript para ver esta página | abilita attiva javascript per visualizzare questa pagina | schakel javascript in om deze pagina te bekijken | включите javascript чтобы продолжить | в вашем браузере отключен javascript
请启用 javascript 后继续浏览 | 您的浏览器不支持 javascript | javascriptを有効にしてください""".replace("\n", " | ").split(" | ")
ERRORS = """404 not found | page not found | error 404 | error 404 page does not exist | this page could not be found | the requested url was not found on this server | the page you asked for could not be found | the page you are looking for has moved or been removed
500 internal server error | internal server error | 502 bad gateway | 503 service temporarily unavailable | service unavailable | 504 gateway timeout | 403 forbidden | 401 unauthorized | 400 bad request | 429 too many requests | too many requests slow down | http error
access denied | permission denied | you are not authorized to view this page | you do not have permission to access this page on this server | your session has expired please log in again | the request timed out please try again later | this site is down for maintenance | we will be back shortly
could not connect to the database | error establishing a connection to the database | an unexpected error occurred while rendering this page | an error occurred | looks like something went wrong | this page is not available | we could not find what you were looking for | you do not have access to this page | something went wrong | the connection has timed out | this document could not be loaded by the viewer | this page cannot be displayed
this site cannot be reached | application error a client side exception has occurred | this account has been suspended | this content is no longer available
page introuvable | page introuvable erreur 404 | cette page n existe pas | accès refusé | erreur interne du serveur | seite nicht gefunden | die seite wurde nicht gefunden | zugriff verweigert | interner serverfehler | página no encontrada | error interno del servidor | acceso denegado
página não encontrada | acesso negado | erro interno do servidor | pagina non trovata | accesso negato | pagina niet gevonden | страница не найдена | доступ запрещён | ошибка сервера
页面不存在 | 页面未找到 | 服务器内部错误 | 服务器内部错误请稍后再试 | 拒绝访问 | 无法访问此网站 | 系统维护中 | ページが見つかりません""".replace("\n", " | ").split(" | ")
FILLER = """⟨again and again⟩ | placeholder text | this is a placeholder paragraph replace this text with your own | dummy text | sample text | your text here | your content here | content goes here | text goes here | insert text here | write something about this page
add your description here | replace this text with your content | content coming soon | lorem ipsum | texte provisoire à remplacer | votre texte ici | blindtext bitte ersetzen | hier steht ihr text | texto de relleno | su texto aquí
texto provisório a substituir | seu texto aqui | testo segnaposto | текст заполнитель | здесь будет ваш текст | 此处为占位文字 | 在此输入文字 | 示例文本""".replace("\n", " | ").split(" | ")
#: What stands in an unfilled slot between delimiters that also enclose ordinary text.
SLOTS = """insert here | name here | insert name here | insert name | enter your name | your name | your company name | your address here | first name | last name | full name | company name | add summary | describe the part here | name of operator | tbd | tba | tbd fill in later
to be completed | to be determined | fill in later | to do | dd.mm.yyyy | yyyy-mm-dd | mm/dd/yyyy | serial | serial number | phone number | city state zip | insert image here | insérer le nom ici | votre nom | hier titel einfügen | ihr name
insertar nombre aquí | su nombre | inserir nome aqui | seu nome | inserire nome | вставьте имя | ваше имя | 此处填写名称 | 请填写名称 | 填写日期 | 您的姓名""".replace("\n", " | ").split(" | ")
#: Words of the common filler text; a passage that is made of them, or of words with their first four letters, is filler.
FILLER_WORDS = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat "
    "proident sunt culpa qui officia deserunt mollit anim laborum pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum tortor "
    "quam feugiat vitae ultricies eget ante donec eu libero mauris placerat eleifend leo quisque semper est aenean ligula curabitur integer fusce risus dictum sodales orci "
    "platea dictumst nonummy nibh euismod tincidunt praesent vivamus dummy"
)
#: Text that has such things as its subject, and is no case.
SUBJECTS = """we tested the page with javascript switched off and it stayed readable | the guide says that javascript is needed only for charts | the server answers 404 not found when a page was moved and the crawler notes the address
the log shows 503 service unavailable after three tries | the designers used lorem ipsum in the draft and replaced it by the final text | write the name of the operator in the field | how to fix error 404 on your site""".replace("\n", " | ").split(" | ")

_INNER = r"[^\W\d_][^{}<>\[\]@%$\n]{0,40}?"
#: Delimiters that hardly enclose anything else, and those that need a slot's phrase or an identifier between them.
_STRONG = re.compile(rf"\{{\{{ ?{_INNER} ?\}}\}}|\$\{{{_INNER}\}}|\[\[{_INNER}\]\]|@@{_INNER}@@|\{{%[ -]?{_INNER} ?%\}}|(?<![\w])_{{2,3}}{_INNER}_{{2,3}}(?![\w])")
_WEAK = re.compile(r"<([^<>\n]{2,60})>|\[([^\[\]\n]{2,60})\]|\(([^()\n]{2,60})\)|«([^«»\n]{2,60})»|%([^%\n]{2,60})%|#([^#\n]{2,60})#|\$([^$\n]{2,60})\$|(?<![\w])_{2,3}([^_\n]{2,60})_{2,3}(?![\w])")
_DELIMITER = re.compile(r"\{\{|\$\{|@@|\{%|__|[<\[(«][^\W\d]|[%#$][^\W\d][^%#$\n]*[%#$]")
_IDENTIFIER = re.compile(r"(?:[a-z]+(?:_[a-z]+)+|[A-Z]+(?:_[A-Z]+)+)$")
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”")
_TERM = re.compile(r"[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+|\d+")
_LOGGED = re.compile(r"\[?\d{2,4}[-/.:]\d{2}[-/.:]?\d{2}|\[\d+\.\d+\]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")


def terms(line: str) -> list[str]:
    """The terms of a passage: words, with those that say the same as one; numbers as one sign, but for codes of three digits."""
    return [_term[t] for t in _TERM.findall(line.casefold()) if t not in NEUTRAL]


def _keys(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def slots(line: str) -> list[tuple[str, str]]:
    """(delimiters, inner text) of what may be an unfilled slot: it stands alone, not as part of a path, word, code or quotation."""
    found: list[tuple[str, str]] = []
    quoted = None
    for pattern in (_STRONG, _WEAK):
        for m in pattern.finditer(line):
            a, b = m.span()
            before, after = line[a - 1 : a] if a else "", line[b : b + 1]
            if before.isalnum() or after.isalnum() or before in ("/", "\\") and before or after in ("/", "\\") and after:
                continue
            if quoted is None:
                quoted = [q.span() for q in _QUOTED.finditer(line)]
            if not any(x <= a and b <= y for x, y in quoted):
                found.append((m[0][0] if pattern is _STRONG else "", m[0] if pattern is _STRONG else next(g for g in m.groups() if g is not None).strip()))
    return found


@dataclass
class Exemplar:
    label: str
    text: str
    weight: dict[str, float]
    whole: float


class Exemplars:
    """The labelled exemplars with their weights, and the index of their terms."""

    def __init__(self, df: np.ndarray, total: int, s: Settings):
        self.df, self.total, self.s = df, max(total, 1), s
        self.idf_known: dict[str, float] = {}
        self.exemplars: list[Exemplar] = []
        self.words: dict[str, set[str]] = {}  # of each label, the terms that its exemplars explain
        for label, texts in (("notice", NOTICES), ("error", ERRORS), ("filler", FILLER), ("subject", SUBJECTS), ("placeholder", SLOTS), ("bag", [FILLER_WORDS])):
            for text in texts:
                weight = {t: self.idf(t) for t in ([text] if text == REPEATED else terms(text))}
                self.exemplars.append(Exemplar(label, text if label != "bag" else "filler words", weight, sum(weight.values())))
                self.words.setdefault(label, set()).update(weight)
        self.stems = {w[:4] for w in FILLER_WORDS.split() if len(w) > 4}
        self.index: dict[str, list[int]] = {}
        for i, e in enumerate(self.exemplars):
            for t in e.weight:
                self.index.setdefault(t, []).append(i)
        # The rarest terms retrieve: of each exemplar, those that few texts hold, at least one. Slots are retrieved by any term.
        self.anchors: set[str] = set()
        for e in self.exemplars:
            if e.label not in ("placeholder", "subject"):
                rare = [t for t in e.weight if self._share(t) <= self.s.anchor_share]
                self.anchors.update(rare or [max(e.weight, key=e.weight.get)])
    def _share(self, term: str) -> float:
        return float(lookup(self.df, _keys([term]))[0]) / self.total

    def idf(self, term: str) -> float:
        got = self.idf_known.get(term)
        if got is None:
            if len(self.idf_known) > 1 << 17:
                self.idf_known.clear()
            n = float(lookup(self.df, _keys([term]))[0])
            got = self.idf_known[term] = math.log((self.total + 1) / (min(n, self.total) + 0.5)) + 0.05
        return got

    def match(self, held: list[str], coverage: float, slot: bool = False) -> tuple[str, str, float, float] | None:
        """(label, exemplar, containment, coverage) of the residue in a window of terms, or None."""
        near = {i for t in held if slot or t in self.anchors for i in self.index.get(t, ())}
        if not near:
            return None
        once = set(held)
        near = [e for e in (self.exemplars[i] for i in near) if slot == (e.label == "placeholder")]
        near = [(e, sum(e.weight[t] for t in once & e.weight.keys()) / e.whole) for e in near]
        near = [(e, c) for e, c in near if e.label == "bag" or c >= (0.5 if e.label == "subject" else self.s.containment)]
        if all(e.label == "subject" for e, _ in near):
            return None
        weights = [(t, self.idf(t)) for t in held]
        total = sum(w for _, w in weights)
        best = subject = None
        for e, contained in near:
            if e.label == "bag":
                cover = sum(w for t, w in weights if t in e.weight or t[:4] in self.stems) / total
                fits = cover >= self.s.coverage and len(once & e.weight.keys()) >= self.s.bag_terms
            else:
                words = e.weight if e.label == "subject" else self.words[e.label]
                cover = sum(w for t, w in weights if t in words) / total
                fits = cover >= (0.5 if e.label == "subject" else coverage)
            if fits and e.label == "subject":
                subject = max(subject or 0.0, contained * cover)
            elif fits and (best is None or contained * cover > best[2] * best[3]):
                best = (e.label, e.text, contained, cover)
        if best is None or subject is not None and best[0] != "bag" and subject > best[2] * best[3]:
            return None
        return best

    def slot(self, line: str) -> tuple[str, str, float, float] | None:
        """The residue in the slots of a line: delimiters that enclose nothing else, an identifier, or an exemplar's phrase."""
        for strong, inner in slots(line):
            if strong:
                return "placeholder", f"{strong}...", 1.0, 1.0
            if _IDENTIFIER.match(inner):
                return "placeholder", "identifier", 1.0, 1.0
            if hit := self.match(terms(inner), self.s.slot, slot=True):
                return hit
        return None

    def residue(self, text: str) -> list[tuple[str, str, float, float]]:
        """All residue of a text, window by window; fenced code and log lines are left out."""
        slotted = _DELIMITER.search(text) is not None
        found, fenced = [], False
        before: list[list[str]] = []  # the terms of up to two lines before, of the same paragraph, that are no residue

        def windows(sentences: list[list[str]], line: list[str]) -> Iterator[tuple[list[str], float]]:
            yield line, self.s.coverage
            for k in range(1, len(before) + 1):
                yield [*(t for one in before[-k:] for t in one), *line], self.s.coverage
            if len(sentences) > 1:
                for i, one in enumerate(sentences):
                    yield one, self.s.sentence
                    if i:
                        yield sentences[i - 1] + one, self.s.sentence

        for raw in text.splitlines():
            line = raw.strip()
            if line.startswith("```"):
                fenced, before = not fenced, []
                continue
            if not line or fenced or _LOGGED.match(line):
                before = []
                continue
            hit = self.slot(line) if slotted and _DELIMITER.search(line) else None
            sentences = [terms(one) for one in _SENTENCE.split(line)] if hit is None else []
            held = sentences[0] if len(sentences) == 1 else [t for one in sentences for t in one]
            if len(held) >= self.s.repeats and len(held[0]) > 1 and held.count(held[0]) == len(held):
                sentences, held = [], [REPEATED]
            if hit is None and not (self.anchors.isdisjoint(held) and all(self.anchors.isdisjoint(x) for x in before)):
                hit = next((h for w, c in windows(sentences, held) if not self.anchors.isdisjoint(w) and (h := self.match(w, c))), None)
            if hit:
                found.append(hit)
                before = []
            else:
                before = [*before[-1:], held]
        return found


def document_frequencies(df: DataFrame, text: str, s: Settings) -> tuple[np.ndarray, int]:
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held: list[int] = []
        for t in batch.column(0).to_pylist():
            if t:
                held += map(xxhash.xxh3_64_intdigest, set(terms(t)))
            if len(held) > 1 << 19:
                yield np.array(held, np.uint64)
                held = []
        if held:
            yield np.array(held, np.uint64)

    one = df.select(text)
    return hashed_counts(one, keys, s.df_bits, 2), one.count()


def residue(df: DataFrame, key: str, text: str, s: Settings = Settings()) -> DataFrame:
    """``key, labels, exemplars, passages, coverage`` of every row whose text holds residue: what kinds, which exemplars were
    met, in how many passages, and the best coverage. Null, empty and blank texts give no row."""
    counts, total = document_frequencies(df, text, s)
    sent = df.sparkSession.sparkContext.broadcast((counts.astype(np.uint32), total))  # 2 * 2**df_bits cells, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Exemplars(*sent.value, s)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                if t and (hits := known.residue(t)):
                    rows.append((k.as_py(), sorted({h[0] for h in hits}), sorted({h[1] for h in hits}), len(hits), max(h[3] for h in hits)))
            cols = list(zip(*rows)) or [[]] * 5
            types = (batch.schema.field(0).type, pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], [key, "labels", "exemplars", "passages", "coverage"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, labels array<string>, exemplars array<string>, passages int, coverage double")
