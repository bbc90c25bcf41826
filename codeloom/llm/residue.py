"""Documents that are template residue, filler, error pages or notices instead of content (problem 10).

Method: normalised lines are counted by host, once for each distinct text; lines that recur on a host are its boilerplate and are
subtracted, whatever they say; a record is excluded when the rest holds unfilled slots, or is mostly
filler, stubs, errors or access, script and waiting notices.  Where nothing is left, the whole record is judged.  A slot that was never
filled in stays one however often it recurs.

The counts are over all documents; a text without any evidence can't be excluded whatever is subtracted, so only lines of texts with
evidence are looked up, and only their hashes (line, text), combined before the shuffle, are shuffled and counted.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.trigrams import _parser, _strings

#: A line is boilerplate of a host from this many of its distinct texts on, and from this share.
RECURRENT_DOCUMENTS = 5
RECURRENT_SHARE = 0.001

# fixed values: slots of template languages, and bracketed requests to fill something in
SLOT = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%[=-]?[^%\n]{1,60}%>|\$\{[A-Za-z_][\w.]{0,40}\}|%\([A-Za-z_]\w{0,40}\)[sd]|\[\[[A-Za-z_][\w .]{0,40}\]\]|@@[A-Za-z_]\w{0,40}@@|(?<![\w.@])@[a-z_]{2,30}@(?!\w)"
    r"|(?<![\w_])__[A-Z][A-Z0-9_]{1,30}__(?!\w)|(?<![\w$%{}])\{[a-z_][a-z0-9_]{1,30}\}(?!\})|<(?:YOUR|INSERT|ENTER|ADD|MY)[ _-][A-Z0-9 _-]{1,40}>|<(?:your|insert|enter|add)[ _-][a-z0-9 _-]{1,40}>"
    r"|\[(?:INSERT|YOUR|ENTER|ADD|NAME OF|TODO|TBD|FILL)\b[^\]\n]{0,50}\](?!\()|\[(?:your|insert|enter|add|fill in|name of)\b[^\]\n]{1,50}\](?!\()|#\{[a-z_][\w.]{0,40}\}"
)
# fixed values: words of sentences that explain slots
EXPLAINS = re.compile(
    r"\b(?:never|replac\w+|stands? for|lint\w*|engine|braces|brackets|syntax|escap\w+|expand\w* to|interpolat\w+|substitut\w+|placeholders?|left in|means?|denotes?|written as|literal\w*|such as|e\.g|instead of|ersetz\w+|steht für|reemplaz\w+|significa|remplac\w+|signifie|substitu\w+)\b",
    re.I,
)

# fixed values: whole sentences or lines that are no content, by kind
_ERROR = [
    r"(?:error|http|status)?[ :]*(?:400|401|403|404|405|408|410|418|429|500|501|502|503|504|520|521|522|523|524|525)\b(?:[ :.-]*(?:bad request|unauthorized|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out|error|page).*)?\W*$",
    r"error [45]\d\d\b", r"(?:bad request|unauthorized|forbidden|not found|too many requests|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)\W*$",
    r".*\b(?:page|file|url|document|article|resource|site)\b.{0,30}\b(?:not found|cannot be found|could not be (?:found|loaded)|can't be found|doesn't exist|does not exist|no longer exists|has been (?:moved|removed|deleted))", r".*\bwe can(?:'|no|’)?t find (?:the|that|this) page", r"oops\b", r"(?:the )?address may have changed", r"go back home\b", r"return to (?:the )?home",
    r"fatal error\b", r"(?:parse|syntax|runtime|uncaught|unhandled)\b.{0,20}\b(?:error|exception)\b.{0,80}\bline \d", r"error: ", r"(?:warning|notice): .{0,60} in /", r"traceback \(most recent call last\)", r"file \"[^\"\n]*\", line \d+", r"exception in thread\b", r"\w*(?:Error|Exception): \S", r"at [\w.$]+\([\w.]+:\d+\)",
    r"upstream connect error\b", r"reset reason\b", r"connection (?:failure|refused|reset|timed out)", r"(?:the|this) server (?:at|encountered|is|was)\b.{0,60}\b(?:unable|error|down|busy|complete)", r"reference #", r"(?:your )?request was blocked", r"incident \d", r"ray (?:id)?:? ?[0-9a-f]{6,}", r"\w+/\d+\.\d+(?:\.\d+)?\W*$",
    r"(?:this|the|our) (?:site|page|service|website) is (?:currently |temporarily )?(?:down|unavailable|offline|under (?:maintenance|construction))", r"(?:please )?try again (?:in|later|shortly)", r"something went wrong", r"an? (?:unexpected |internal |unknown )?error (?:has )?occurred", r"error loading\b", r"failed to (?:load|fetch)\b", r"undefined\W*$", r"null\W*$", r"nan\W*$", r"\[object object\]",
    r"(?:seite|datei) (?:wurde )?nicht gefunden", r"p[áa]gina no encontrada", r"page (?:introuvable|non trouvée)", r"p[áa]gina não encontrada", r"zugriff verweigert", r"acceso denegado", r"accès refusé", r"acesso negado", r"interner serverfehler", r"error interno", r"erreur interne", r"erro interno", r"die adresse\b.{0,30}geändert", r"la dirección\b.{0,30}cambiado", r"l'adresse\b.{0,30}changé", r"o endereço\b.{0,30}mudado", r"ein fehler ist aufgetreten", r"ha ocurrido un error", r"une erreur est survenue", r"ocorreu um erro",
]
_NOTICE = [
    r".*\b(?:enable|turn on|activate|allow|requires?|needs?)\b.{0,40}\b(?:javascript|scripts?|scripting|cookies)\b", r".*\bjavascript (?:is|must be|has to be) (?:disabled|required|enabled|off|turned)", r".*\bif .{0,40} does not appear, allow scripts", r"turn it on to\b", r".*\bnoscript\b", r".*\b(?:aktivier\w*|activ\w+|habilit\w+|ativ\w+|einschalten|erforderlich)\b.{0,30}\bjavascript\b", r".*\bjavascript\b.{0,40}\b(?:aktivier\w*|deaktiviert|activ\w*|desactivado|désactivé|habilit\w*|ativ\w+|desativado|erforderlich|requis|requerido|necessário)\b",
    r".*\byour browser before accessing\b", r".*\bchecking your browser\b", r"just a moment", r"(?:please )?wait\b.{0,60}\b(?:redirect|while|moment|second|checking|load)", r"(?:please )?(?:stand by|wait)\W*$", r"you (?:are|will be) (?:being )?redirected", r"redirecting\b", r"loading\W*$", r".*\bthis takes? (?:about |up to )?\d+ seconds?", r".*\b(?:verify|confirm|prove)\b.{0,30}\b(?:you are|you're|that you are) (?:a )?(?:human|not a robot)", r".*\bcaptcha\b", r".*\bare you (?:a )?(?:human|robot)",
    r"access (?:denied|restricted|to this)", r"you (?:do not|don't) have (?:permission|access)", r"permission denied", r"(?:please )?(?:sign|log) ?in\b(?:.{0,80}\b(?:to|read|continue|view|again|account)\b.*)?\W*$", r"sign up\b", r"(?:your )?session (?:has )?expired", r"you (?:must|need to) (?:be (?:signed|logged) in|sign in|log in)", r"log in again\b", r"members? only", r"subscribe to (?:read|continue)", r"this content is (?:only )?(?:available|restricted|for)\b", r"skip to (?:main )?content", r"accept (?:all )?cookies", r"we use cookies\b",
    r"(?:bitte )?(?:melden sie sich|anmelden)\b", r"inici(?:e|a|ar) sesión", r"(?:veuillez )?(?:vous connecter|connectez-vous)", r"(?:faça|fazer|inicie) (?:o )?login", r"(?:bitte )?warten\b", r"espere\b.{0,40}\b(?:momento|mientras)", r"veuillez patienter", r"(?:por favor,? )?aguarde", r"vuelva a cargar", r"veuillez activer",
]
_STUB = [
    r"(?:todo|tbd|tba|fixme|xxx|wip|n/a|placeholder|coming soon|to be (?:written|done|added|determined|announced|completed)|under construction|work in progress|more to come|nothing here yet|empty|untitled|draft|content)\W*$", r"todo\b[ :-]*(?:write|add|document|fill|describe|explain)\b", r"(?:this )?(?:section|page|chapter|document) (?:is|has been) (?:intentionally )?(?:empty|blank|left blank|under construction|a stub|a placeholder|incomplete|not (?:yet )?written)",
    r"(?:your |sample |dummy |placeholder |some |example )?(?:text|content|title|heading|description|body|paragraph)s? (?:goes|go|here)\b(?: here)?", r"(?:describe|explain|add|insert|write|put|enter|type|document)\b.{0,60}\b(?:here|to use it|of the project|below|your (?:text|content))\W*$", r"explain how to use\b", r"add an? (?:short|brief|one-line) ", r"(?:sample|dummy|placeholder|example|filler) (?:text|content)\b", r"this is (?:a )?(?:placeholder|dummy|sample|filler|test)\b", r"replace this\b", r"lorem ipsum", r"(?:hier )?(?:folgt|steht) (?:bald|demnächst|später)", r"(?:próximamente|pendiente|por hacer|por escribir)\W*$", r"(?:bientôt|à venir|à compléter|à rédiger|à faire)\W*$", r"(?:em breve|a fazer|por escrever|a definir)\W*$", r"(?:kommt bald|noch zu schreiben|in arbeit|platzhalter)\W*$",
]
_EVIDENCE = {k: re.compile(r"\W*(?:" + "|".join(v) + ")", re.I) for k, v in (("error", _ERROR), ("notice", _NOTICE), ("stub", _STUB))}
# fixed values: words of filler text
_LOREM = set("lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed eiusmod tempor tempus incididunt labore dolore magna aliqua enim minim veniam nostrud".split())
_MASH = re.compile(r"(?:asdf\w*|qwert\w*|blah|foo|bar|baz|xxx+|aaa+|test|text|bla|lkj\w*|hjkl\w*)$")


def _literals(tree: object, leading: bool = False) -> set[str] | None:
    """Strings in lower case of which every match of the tree has one, or None: the set whose shortest string is longest.

    ``leading``: the match follows non-word characters at the start of a sentence, "\n" stands for that start.
    """
    sets: list[set[str]] = []
    runs, first = [""], leading  # the strings that the literals so far can be

    def close() -> None:
        nonlocal runs, first
        lower = {r.lower() for r in runs}
        if first and all(r[:1].isalnum() for r in lower):
            sets.append({"\n" + r for r in lower})
        elif all(lower):
            sets.append(lower)
        runs, first = [""], False

    for op, value in tree:
        name = str(op)
        spelled = _strings([(op, value)])
        if spelled is not None and len(spelled) * len(runs) <= 256:
            runs = [r + x for r in runs for x in spelled]
        elif name not in ("AT", "ASSERT_NOT", "ASSERT"):
            start = first and runs == [""]
            close()
            if name == "SUBPATTERN":
                sets.append(_literals(value[-1], start) or set())
            elif name == "BRANCH":
                each = [_literals(b, start) for b in value[1]]
                sets.append(set().union(*each) if all(each) else set())
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
                sets.append(_literals(value[2]) or set())
    close()
    # a start is worth some letters, and any character but a letter is worth more than a letter
    return max(filter(None, sets), key=lambda x: min(sum(3 if c == "\n" else 1 if c.isalnum() or c in " ." else 2 for c in r) for r in x), default=None)


def _build() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    alternatives = [(p, True) for p in _ERROR + _NOTICE + _STUB] + [(SLOT.pattern, False)]
    for pattern, leading in alternatives:
        found = _literals(_parser.parse(pattern), leading)
        if found is None:
            raise ValueError(f"no literal in {pattern}")
        for h in found:
            automaton.add_word(h, 1)
    automaton.make_automaton()
    return automaton


_AUTOMATON = _build()
_START = re.compile(r"\W*")
_FOLDED = str.maketrans("İıſ", "iis")  # what re.I takes for a letter and lower() does not


def _lower(text: str) -> str:
    return (text if text.isascii() else text.translate(_FOLDED)).lower()


def hinted(sentence: str) -> bool:
    """Whether a sentence has any of the literals that the patterns require; one without them has no evidence."""
    start = _START.match(sentence).end()
    return next(_AUTOMATON.iter(_lower(sentence[:start] and sentence + "\n" + sentence[start:] or "\n" + sentence)), None) is not None


_FILLS = re.compile(r"ipsum|asdf|qwert|blah|\bbla bla|foo bar|\b(\w+) \1 \1\b|xxx|aaa|lkj|hjkl", re.I)
_FILL_WORDS = ("ipsum", "asdf", "qwert", "blah", "bla bla", "foo bar", "xxx", "aaa", "lkj", "hjkl")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)[\s\S]*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.M)
_SHOWN = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“\n]*[“”]")
_HOST = re.compile(r"\W*(?:https?://)?[\w-]+(?:\.[\w-]+)+(?:/\S*)?\W*$")


def _count(text: str) -> int:
    return len(re.findall(r"\w+", text))


def _fills(text: str) -> bool:
    """Whether _FILLS matches: the expression only sees texts with one of its literals, or with a word between its equals."""
    lower = _lower(text)
    if not any(w in lower for w in _FILL_WORDS):
        words = lower.split(" ")
        if not any(b and c.startswith(b) and a.endswith(b) for a, b, c in zip(words, words[1:], words[2:])):
            return False
    return bool(_FILLS.search(text))


def _filler(words: list[str]) -> bool:
    if len(words) >= 2 and all(map(_MASH.match, words)) or len(words) >= 3 and len(set(words)) == 1:
        return True
    return len(words) >= 5 and sum(w in _LOREM for w in words) >= max(2, 0.12 * len(words)) and not any(w in ("the", "words", "with", "and", "of") for w in words)


def _read(text: str, boilerplate: Collection[int], subtract: bool) -> tuple[dict[str, int], int, bool | None, int]:
    """(words of evidence by kind, words of content, whether evidence leads, slots) of a text.

    Lines of ``boilerplate`` are passed over, or, without ``subtract``, are at least no content.
    """
    code = 0
    kept = text
    for m in _FENCE.finditer(text):
        code += _count(m[0])
    if code:
        kept = _FENCE.sub(lambda m: "\n" * m[0].count("\n"), text)
    weights = {"slot": 0, "filler": 0, "stub": 0, "error": 0, "notice": 0}
    content, leading, slots = code, None, 0
    trace, fills = False, _fills(kept)
    for number, line in enumerate(kept.split("\n")):
        if not line.strip():
            continue
        recurrent = number in boilerplate
        if line.startswith(">") or (line.startswith(("    ", "\t")) and not trace):
            content += 0 if recurrent and subtract else _count(line)
            continue
        heading = bool(re.match(r"#{1,6}\s", line))
        entry = re.sub(r"^\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+)", "", line)
        trace = trace and line.startswith((" ", "\t")) or entry.startswith("Traceback (most recent call last)")
        for sentence in re.split(r"(?<=[.!?])\s+", entry):
            plain = _SHOWN.sub(" ", sentence)
            near = fills or hinted(sentence) or plain != sentence and hinted(plain)
            found = SLOT.findall(plain) if near else []
            if found and not EXPLAINS.search(plain):
                slots += len(found)
                weights["slot"] += _count(sentence)
                continue
            if heading and not (near and any(e.match(plain) for e in _EVIDENCE.values())) or _HOST.match(plain):
                continue  # a heading or an address alone is neither content nor evidence
            words = re.findall(r"[^\W\d_]+", plain.casefold()) if fills or leading is None else []
            kind = "filler" if fills and _filler(words) else next((k for k, e in _EVIDENCE.items() if e.match(sentence if k == "error" else plain)), None) if near else None
            if kind and not (recurrent and subtract):
                weights[kind] += max(1, _count(sentence))
                leading = True if leading is None else leading
            elif not kind:
                content += 0 if recurrent else _count(sentence)
                leading = False if leading is None and words else leading
    return weights, content, leading, slots


def evident(text: str) -> bool:
    """Whether a text has any evidence at all."""
    weights, _, _, slots = _read(text, (), False)
    return bool(slots or sum(weights.values()))


def residue(text: str, boilerplate: Collection[int] = ()) -> str | None:
    """Why a text is no content (slot, filler, stub, error or notice), or None.  ``boilerplate``: numbers of its lines, from 0, that recur on its host."""
    weights, content, leading, slots = _read(text, boilerplate, True)
    if boilerplate and not slots and not content and not sum(weights.values()):
        weights, content, leading, slots = _read(text, boilerplate, False)  # nothing but boilerplate
    if slots:
        return "slot"
    evidence = sum(weights.values())
    if not evidence:
        return None
    mostly = content <= max(evidence, 12) if leading else evidence > 2 * content
    return max(weights, key=lambda k: weights[k]) if mostly else None


def _lines(text: str) -> F.Column:
    """Normalised lines of a text: lower case, digits as 0, trimmed."""
    return F.split(F.regexp_replace(F.lower(F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))), "[0-9]+", "0"), r"\s*\n\s*")


def residual_documents(documents: DataFrame, least: int = RECURRENT_DOCUMENTS, share: float = RECURRENT_SHARE) -> DataFrame:
    """(doc_id, reason) of every document that is residue instead of content.

    Input: doc_id, text, source.  A null or empty text is no residue; a row without an id is left out; a document
    delivered twice comes out once; a null source is a host of its own.  Counts cover all rows, copies of
    a text on a host (equal but for case, digits and space) as one; whole texts are read.
    """

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([evident(t) for t in b.column("text").to_pylist()], pa.bool_()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, r) for i, t, n in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "recurrent"))) if (r := residue(t, set(n or ())))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["doc_id", "reason"])

    from codeloom.session import written

    rows = documents.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    suspects = written(rows.mapInArrow(suspect, rows.schema), "residue-suspects")
    numbered = suspects.select("doc_id", "source", F.posexplode(F.split(F.regexp_replace(F.lower("text"), "[0-9]+", "0"), "\n")).alias("number", "line"))
    hashed = numbered.select("doc_id", "source", "number", F.xxhash64("source", F.regexp_replace("line", r"^\s+|\s+$", "")).alias("hash"))
    # every document's lines, cut down to lines of suspects before anything is shuffled
    lined = rows.select("source", _lines("text").alias("lines")).select("source", "lines", F.xxhash64("lines").alias("copy"))
    lines = lined.select("source", "copy", F.explode(F.array_distinct("lines")).alias("line")).where("line <> ''").select(F.xxhash64("source", "line").alias("hash"), "copy")
    counted = lines.join(hashed.select("hash").distinct(), "hash", "left_semi").distinct().groupBy("hash").count().where(F.col("count") >= least)
    hosts = lined.select("source", "copy").distinct().groupBy("source").agg(F.count("*").alias("documents"))
    recurrent = hashed.join(counted, "hash").join(hosts, "source").where(F.col("count") >= F.col("documents") * share)
    grouped = recurrent.groupBy("doc_id").agg(F.collect_set("number").alias("recurrent"))
    return suspects.join(grouped, "doc_id", "left").select("doc_id", "text", "recurrent").mapInArrow(judge, "doc_id bigint, reason string").dropDuplicates(["doc_id"])
