"""Defective question and answer pairs, each with its one defect (problem 7).

Method: a suffix automaton of the prompt is traversed by the response, which measures how much of the response is
copied from it; a refusal automaton (all phrases in one trie walk) finds who declines; a stack of delimiters and the
shape of the last line show what breaks off; stopword votes and scripts tell the languages.

Defects are tried in a fixed order (empty, copy, refusal, wrong_language, truncated); the first that holds is the one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: labels and stand-ins that carry no answer
LABELS = {
    "a", "answer", "antwort", "respuesta", "réponse", "reponse", "resposta", "response", "reply", "result", "assistant", "bot", "q", "question", "frage", "pregunta", "pergunta",
    "final", "output", "ai", "system", "r",
}
STAND_INS = {
    "", "none", "null", "nil", "na", "n a", "nan", "undefined", "no response", "no answer", "no reply", "no output", "no result", "no data", "empty", "blank", "tbd", "todo", "missing",
    "not available", "not applicable", "no answer available", "no answer provided", "no response provided", "no response available", "answer here", "your answer here", "insert answer here", "to be answered",
    "keine antwort", "keine", "sin respuesta", "ninguna", "pas de réponse", "aucune réponse", "aucune", "sans réponse", "sem resposta", "nenhuma", "no content", "unanswered", "response", "answer", "br", "p", "eos", "pad", "endoftext", "nbsp",
}

# fixed values: phrases that decline.  An asterisk stands for up to four words.
REFUSALS = [
    "can't help with", "cannot help with", "can not help with", "can't help you", "cannot help you", "unable to help", "can't assist", "cannot assist", "unable to assist", "not able to assist", "not able to help", "not something i can",
    "i can't answer", "i cannot answer", "not able to answer", "unable to answer", "won't be able to", "will not be able to", "i'm not able to", "i am not able to", "i'm unable to", "i am unable to", "must decline", "have to decline", "i decline to", "i'd rather not", "i would rather not",
    "i prefer not to", "cannot provide", "can't provide", "unable to provide", "not allowed to", "not permitted to", "i'm allowed to discuss", "i am allowed to discuss", "can't discuss", "cannot discuss", "can't comment", "cannot comment", "rather not comment", "can't share", "cannot share",
    "i refuse to", "i won't answer", "i will not answer", "against my guidelines", "against my policy", "i can't do that", "i cannot do that", "i can't fulfill", "i cannot fulfill", "i can't comply", "i cannot comply", "as an ai", "as a language model", "beyond what i'm allowed", "beyond what i am allowed", "outside my scope", "outside the scope of what i",
    "kann ich nicht helfen", "kann ich leider nicht helfen", "nicht weiterhelfen", "kann ich nicht beantworten", "kann ich leider nicht beantworten", "darf ich leider keine", "darf ich keine", "darf ich nicht", "keine auskunft", "möchte ich nichts sagen", "nicht dazu äußern", "muss ich ablehnen", "ich kann ihnen dabei nicht", "ich kann dabei nicht", "nicht in der lage",
    "no puedo ayudar", "no puedo ayudarte", "no puedo ayudarle", "no puedo responder", "no puedo contestar", "no me está permitido", "no me esta permitido", "no estoy autorizado", "no tengo permiso", "no puedo proporcionar", "prefiero no", "debo rechazar", "no puedo asistir", "no puedo hablar", "no puedo comentar",
    "ne peux pas vous aider", "ne peux pas t'aider", "ne peux pas aider", "ne peux pas répondre", "pas autorisé à", "pas autorisée à", "ne suis pas en mesure", "ne puis pas", "je dois refuser", "je préfère ne pas", "ne peux pas fournir", "ne peux pas commenter", "pas le droit de", "impossible de vous aider",
    "não posso ajudar", "não posso responder", "não tenho permissão", "não estou autorizado", "não estou autorizada", "não me é permitido", "não posso fornecer", "prefiro não", "devo recusar", "não consigo ajudar", "não posso comentar", "não posso falar", "não sou capaz de",
    "we cannot help", "we can't help", "we are unable to", "not in a position to", "i cannot discuss", "i cannot explain", "i can't explain", "i can't talk about", "i cannot talk about", "i cannot disclose", "i can't disclose", "cannot give you", "cannot reveal", "can't reveal", "i'm afraid i can't", "i'm afraid i cannot",
]

# fixed values: function words (articles, pronouns, prepositions, conjunctions, auxiliaries, adverbs) that vote for a language
STOPWORDS = {
    "en": "the of and to in is are was that it for on with as by from which where what does this would when but not at or an be you if then has have most them because without there i who why how until before after each every been were they their its we our your can could should do did no so only than more both all any other into over whose whom".split(),
    "de": "der die das und ist nicht mit von den dem des ein eine einer einen einem eines wird werden wurde wurden wo wie was warum welche welcher welches wenn auf zu zum zur im am für aus sich dabei nur bei nach mehr als oder sonst bitte zuerst davon danach dann es gibt ihre ihr weil ob auch kann können haben hat er sie wir ich man alle allen diesen dieser dieses diese einzeln durch über unter vor ohne um bis noch schon sehr hier dort jede jeder jedes ihnen welchen wer wem wen".split(),
    "es": "a el la los las de y que en un una es no se por con para del al su sus lo como cómo dónde qué quién cuando cuándo cuál más pero hay sin está están esta este esto entre porque primero casi todas todos ya desde solo sólo unos unas cada donde también fue fueron era son ser usted ni si sí muy sobre hasta pueda puede le les nos otra otro cuáles cuántos cuántas quiénes".split(),
    "fr": "à a vous nous le la les des et est une un du dans que qui pour par avec pas ne se sur au aux ce cet cette ces elle il ils elles on où quand comment pourquoi plus plupart son sa ses leur leurs sont été être comme d'abord sinon faut depuis sans avons parce chaque tous toutes tout aussi mais ou donc y en sous l'un entre encore jamais ainsi quel quelle quels quelles combien lequel laquelle".split(),
    "pt": "o a os as de e que em um uma uns umas é não se por com para do da dos das no na nos nas ao aos à às como onde quando por que quem mais mas há sem está estão entre porque primeiro senão quase todas todos já desde apenas cada pelo pela pelos pelas seu sua seus suas isso isto essa esse esta este você eu foi foram era são ser também nem muito até ou qual quais quanto quantos quantas".split(),
}
#: A word votes once for a language of its own, and a third of a vote for each of several.
_VOTES: dict[str, dict[str, float]] = {}
for _language, _list in STOPWORDS.items():
    for _w in _list:
        _VOTES.setdefault(_w, {})[_language] = 1.0
_VOTES = {w: v if len(v) == 1 else dict.fromkeys(v, 1 / 3) for w, v in _VOTES.items()}

# fixed values: names of languages in a request
REQUESTED = {
    "en": ("english", "englisch", "inglés", "anglais", "inglês", "auf englisch"),
    "de": ("german", "deutsch", "alemán", "allemand", "alemão"),
    "es": ("spanish", "spanisch", "español", "espagnol", "espanhol"),
    "fr": ("french", "französisch", "francés", "français", "francês"),
    "pt": ("portuguese", "portugiesisch", "portugués", "portugais", "português"),
}
_ASKS = re.compile(r"\b(?:answer|reply|respond|write|translate\w*|antwort\w*|schreib\w*|übersetz\w*|respond\w+|contest\w+|escrib\w+|traduc\w+|répond\w*|écri\w+|tradui\w+|respost\w*|escrev\w+|traduz\w*)\b[^.?!\n]*?\b(?:in|into|auf|ins|en|em|para|au)\s+(?:the\s+)?(\w+)", re.I)


class SuffixAutomaton:
    """Of a sequence of words: every path from the start is a run of words that occurs in it."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def copied(self, words: list[str], least: int) -> list[bool]:
        """Which words lie in a run of at least ``least`` words that occurs in the automaton's sequence."""
        out = [False] * len(words)
        state = matched = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            if matched >= least:
                out[i - matched + 1 : i + 1] = [True] * matched
        return out


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.casefold())


def _bare(text: str) -> str:
    """Without markup, invisible characters and label words at the front."""
    text = re.sub(r"<[^<>]*>|\[/?\w+\]", " ", text)
    return " ".join(_words("".join(" " if unicodedata.category(c) in ("Cf", "Cc", "Co") else c for c in text)))


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    bare = _bare(response)
    if not bare.strip("_ "):
        return True
    words = bare.split()
    while words and words[0] in LABELS:
        words = words[1:]
    return " ".join(words) in STAND_INS


def is_copy(query: str, response: str) -> bool:
    """Nothing but the question: all words of the response are copied runs, but for a label of up to four words before a colon."""
    q, r = _words(query), _words(response)
    if not q or not r:
        return False
    automaton = SuffixAutomaton(q)
    least = max(1, -(-len(q) * 6 // 10))
    rest = r
    m = re.match(r"\W*((?:[^\W_]+['’]?\s*){1,4}?)\s*[:：]\s*", response)
    if m and not automaton.copied(_words(m[1]), least).count(True):
        rest = _words(response[m.end() :])
    if not rest:
        return False
    copied = automaton.copied(rest, least)
    return all(copied)


class PhraseAutomaton:
    """All phrases in one automaton over words (a trie with failure links)."""

    def __init__(self, phrases: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.fail = [0]
        self.ends = [False]
        for p in phrases:
            at = 0
            for w in re.findall(r"[\w'’]+", p.casefold()):
                if w not in self.next[at]:
                    self.next[at][w] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append(False)
                at = self.next[at][w]
            self.ends[at] = True
        queue = list(self.next[0].values())
        for at in queue:
            for w, to in self.next[at].items():
                f = self.fail[at]
                while f and w not in self.next[f]:
                    f = self.fail[f]
                self.fail[to] = self.next[f].get(w, 0) if self.next[f].get(w, 0) != to else 0
                self.ends[to] |= self.ends[self.fail[to]]
                queue.append(to)

    def found(self, words: list[str]) -> bool:
        at = 0
        for w in words:
            while at and w not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(w, 0)
            if self.ends[at]:
                return True
        return False


_REFUSALS = PhraseAutomaton([x for p in REFUSALS for x in (p, p.replace("'", "’"))])
_QUOTES = re.compile(r"```[\s\S]*?(?:```|\Z)|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“|`[^`\n]*`")
_CITED = re.compile(r"\[[^\]\n]*:\d+[-–]\d+\]")


#: Words beside a refusal for each of its own words up to which they count as a frame of it, not as an answer.
FRAME = 2


def is_refusal(response: str, query: str | None = None) -> bool:
    """Declines, outside quotes and code, and gives nothing else: no code, no citation, no more than a frame of other words.

    Sentences copied from the question (by its suffix automaton) are no answer, wherever they stand.
    """
    if _CITED.search(response) or "```" in response:
        return False
    plain = _QUOTES.sub(" ", response)
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", plain) if s.strip()]
    declining = {i for i, s in enumerate(sentences) if _REFUSALS.found(re.findall(r"[\w'’]+", s.casefold()))}
    if not declining:
        return False
    asked = _words(query or "")
    automaton = SuffixAutomaton(asked)
    own = [_words(s) for s in sentences]
    rest = [w for i, w in enumerate(own) if i not in declining and not (asked and all(automaton.copied(w, min(len(w), 3))))]
    return sum(map(len, rest)) <= FRAME * sum(len(own[i]) for i in declining)


def languages(text: str) -> tuple[dict[str, float], int]:
    """Votes for each language by function words, over text without code and identifiers; and how many words there are."""
    text = re.sub(r"```[\s\S]*?(?:```|\Z)|`[^`\n]*`|\[[^\]\n]*\]?|\w*_\w*|\w*[a-z][A-Z]\w*|\S*[/\\]\S*|\S+\.\w+\b|\w+\(\)?", " ", text)
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", text.casefold())
    votes = dict.fromkeys(STOPWORDS, 0.0)
    for w in words:
        for language, weight in _VOTES.get(w, {}).items():
            votes[language] += weight
    for w in words:
        for accents, language, weight in (("ß", "de", 2), ("äöü", "de", 1), ("ñ¿¡", "es", 2), ("ãõ", "pt", 2), ("èùûîœ", "fr", 1)):
            if any(c in w for c in accents):
                votes[language] += weight
    if "¿" in text or "¡" in text:
        votes["es"] += 2
    return votes, len(words)


def _script(text: str) -> str:
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return ""
    foreign = sum(ord(c) > 0x24F and not 0x1E00 <= ord(c) < 0x2000 for c in letters)
    return "other" if foreign * 2 > len(letters) else "latin"


def is_wrong_language(query: str, response: str) -> bool:
    asked = {code for m in _ASKS.finditer(query) for code, names in REQUESTED.items() if m[1].casefold() in names}
    qs, rs = _script(query), _script(response)
    if qs and rs and qs != rs:
        return not asked or rs == "other"
    mine, n = languages(response)
    best = max(mine, key=lambda k: mine[k])
    if mine[best] < 1.5 or n < 4:
        return False
    ask, _ = languages(query)
    expected = max(ask, key=lambda k: ask[k])
    if not ask[expected]:
        return False
    fitting = [k for k in asked or {expected}] + [expected]
    own = max(mine[k] for k in fitting)
    return mine[best] >= own * 1.5 + 1


# fixed values: words that never end a sentence
DANGLING = set(
    """the a an of and or to in is are was that for on with as by from which where because when if then but not at be into than its this these those each every while until before after without via per so
    der die das dem den des ein eine einer einem und oder mit von zu zum zur im in auf für aus wird werden ist sind weil wenn dass als bei nach vor
    el la los las de del y o que en un una es por con para al su cuando porque como sin
    le les des et ou du dans qui pour par avec ne se sur au aux ce cette est sont quand parce sans plus que
    os as e em um uma é por com para do da no na dos das ao à quando porque como sem""".split()
)
_CLOSERS = {")": "(", "]": "[", "}": "{"}
_BLOCK = re.compile(r"^[ \t]*(?P<fence>```|~~~)[ \t]*(?P<language>[\w+#-]*)[^\n]*\n(?P<code>(?:(?![ \t]*(?P=fence))[^\n]*\n)*)[ \t]*(?P=fence)[ \t]*\Z", re.M)
_ENTRY = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[-*+•>#]|\d+[.)])\s)|^[ \t]*(?:```|~~~)[^\n]*\n", re.M)
_FACE = re.compile(r"(?<!\w)[:;=]['-]?[(\[{](?!\w)|'[^'\w\n]{1,3}'")
# fixed values: blocks that hold no code, and languages whose comments begin with slashes
PLAIN_BLOCKS = {"text", "txt", "plain", "plaintext", "console", "output", "log", "diff", "patch", "md", "markdown", "sh", "bash", "shell", "zsh", "regex", "html", "xml"}
SLASHED = {"js", "jsx", "javascript", "mjs", "ts", "tsx", "typescript", "java", "c", "cpp", "c++", "cs", "go", "rust", "rs", "kotlin", "swift", "scala", "php", "jsonc"}


def _unclosed(code: str, slashed: bool = False) -> bool:
    """Whether brackets or quotes of the text are still open at its end.  ``slashed``: comments are // and /* */, not #."""
    stack: list[str] = []
    quote, i = "", 0
    while i < len(code):
        c = code[i]
        if quote:
            if c == "\\":
                i += 1
            elif code.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
            elif c == "\n" and quote in ("'", '"'):
                quote = ""
        elif c == "'" and re.search(r"\w$", code[max(0, i - 3) : i]) and not re.search(r"(?<!\w)(?:[rbfu]|[rbf]{2})$", code[max(0, i - 3) : i], re.I):
            pass  # an apostrophe
        elif c in "\"'" or slashed and c == "`":
            quote = c * 3 if not slashed and code.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif not slashed and c == "#" or slashed and code.startswith("//", i):
            while i < len(code) and code[i] != "\n":
                i += 1
        elif slashed and code.startswith("/*", i):
            end = code.find("*/", i + 2)
            if end < 0:
                return True
            i = end + 1
        elif c in "([{":
            stack.append(c)
        elif c in ")]}" and stack and stack[-1] == _CLOSERS[c]:
            stack.pop()
        i += 1
    return bool(stack) or bool(quote)


def _open_bracket(prose: str) -> bool:
    """Whether a bracket of the last paragraph or list entry is still open: quotes, code and faces hold none, and half-open intervals close."""
    depth = 0
    for c in _FACE.sub(" ", _QUOTES.sub(" ", _ENTRY.split(prose)[-1])):
        depth = depth + 1 if c in "([{" else max(0, depth - 1) if c in ")]}" else depth
    return depth > 0


def is_truncated(response: str) -> bool:
    """Breaks off before its last sentence, list entry, citation or code block is complete."""
    text = response.rstrip()
    if not text:
        return False
    if len(re.findall(r"^\s*(?:```|~~~)", text, re.M)) % 2:
        return True
    last = text.split("\n")[-1].strip()
    if last.startswith(("```", "~~~")):
        block = _BLOCK.search(text)  # the last block: only there can the answer break off
        language = block["language"].lower() if block else "text"
        return language not in PLAIN_BLOCKS and _unclosed(block["code"].removesuffix("\n"), language in SLASHED)
    if _open_bracket(text):
        return True
    if re.search(r"\[[^\]\n]*$", last):  # a citation or link that is not closed
        return True
    if last.count("`") % 2 or re.fullmatch(r"(?:[-*+•]|\d+[.)])\s*", last):
        return True
    ending = last.rstrip("*_\"'`”’»)] ")
    while (m := re.search(r"\s*\[[^\]\n]*:\d+[-–]\d+\]$", last)) is not None:  # citations after the last sentence
        last = last[: m.start()]
        ending = last.rstrip("*_\"'`”’»)] ")
    if not ending:
        return False
    if ending[-1] in ",:;–—(+=&" or ending.endswith(" -"):
        return True
    if ending[-1] in ".!?。！？…":
        return ending.endswith(("...", "…")) and not ending.startswith(("...", "…")) and len(_words(ending)) > 3
    words = re.findall(r"[^\W_]+", ending.casefold())
    if words and words[-1] in DANGLING and len(_words(ending)) > 1:
        return True
    prior = [x for x in re.split(r"(?<=[.!?])\s+|\n+", re.sub(r"```[\s\S]*?```", "", text)) if x.strip()]
    listed = bool(re.match(r"\s*(?:[-*+•]|\d+[.)])\s", text.split("\n")[-1]))
    if listed:
        entries = [x for x in text.split("\n") if re.match(r"\s*(?:[-*+•]|\d+[.)])\s", x)]
        finished = [bool(re.search(r"[.!?]\W*$", x)) for x in entries[:-1]]
        if finished and all(finished):
            return True
        shape = [bool(re.search(r"\.\w{1,5}\W*$", x)) for x in entries[:-1]]  # names of files
        return bool(shape) and all(shape) and not re.search(r"\.\w{1,5}\W*$", entries[-1])
    # an unpunctuated end: broken off where the answer otherwise writes full sentences, or where the sentence is long
    return any(re.search(r"[.!?]\W*$", x) for x in prior[:-1]) or len(re.findall(r"\w+", prior[-1] if prior else ending)) >= 5 and not re.fullmatch(r"[\w.`, ]*(?:\band\b|\bund\b|\by\b|\bet\b|\be\b)?[\w.` ]*", ending)


def defect(query: str | None, response: str | None) -> str | None:
    """The one defect of a pair, or None.  A null question makes only empty, refusal and truncated possible."""
    if is_empty(response):
        return "empty"
    if query and is_copy(query, response):
        return "copy"
    if is_refusal(response, query):
        return "refusal"
    if query and is_wrong_language(query, response):
        return "wrong_language"
    return "truncated" if is_truncated(response) else None


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """(id, defect) of every defective pair, each once.

    Input: id, query_text, response_text.  A row without an id is left out; exact redeliveries count once; an id
    delivered with different texts gets a row for each different defect.  Whole texts are read.  Row by row, no
    shuffle but the one that makes rows distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, d) for i, q, r in zip(*(b.column(c).to_pylist() for c in ("id", "query_text", "response_text"))) if (d := defect(q, r))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], b.schema.field("id").type), pa.array([x[1] for x in found], pa.string())], ["id", "defect"])

    kept = pairs.select("id", "query_text", "response_text").where(F.col("id").isNotNull())
    return kept.mapInArrow(run, f"id {dict(pairs.dtypes)['id']}, defect string").distinct()
