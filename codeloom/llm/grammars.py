"""Token streams and grammars of Python, JavaScript and TypeScript for parsing with derivatives."""

from __future__ import annotations

import re

from codeloom.llm.derivatives import Grammar

# --- Python ------------------------------------------------------------------------------------------------------

# fixed values: reserved words
PY_KEYWORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
#: Brackets that the language lets nest.
PY_NESTING = 200
PY_SOFT = {"match": "MATCH", "case": "CASE", "type": "TYPE"}
_PY_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
PY_TOKEN = re.compile(
    r"[ \t\f]+|" + _PY_PREFIX + r"(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*')"
    r"|[^\W\d]\w*|(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)\w*"
    r"|#[^\n]*|\\\n|\n|\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|[+\-*/%@&|^=<>]=|\*\*|//|<<|>>|[\s\S]"
)
_PY_NUMBER = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|0(?:_?0)*|[1-9](?:_?\d)*)$|(?:(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*)$|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]$")
_PY_OPERATORS = {"**=", "//=", ">>=", "<<=", "...", "!=", "->", ":=", "+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^=", "==", "<=", ">=", "**", "//", "<<", ">>", *"()[]{}+-*/%@&|^~<>=.,:;"}


class _PythonKinds(dict):
    """The kind of each token text, learnt as texts come; identifiers of one corpus repeat."""

    def __missing__(self, t: str) -> str:
        c = t[0]
        if t in PY_KEYWORDS or t in _PY_OPERATORS:
            kind = {"+=": "AUG", "-=": "AUG", "*=": "AUG", "/=": "AUG", "%=": "AUG", "@=": "AUG", "&=": "AUG", "|=": "AUG", "^=": "AUG", "**=": "AUG", "//=": "AUG", ">>=": "AUG", "<<=": "AUG"}.get(t, t)
            kind = "BIN" if t in ("/", "%", "&", "|", "^", "<<", ">>", "//", "<", ">", "==", ">=", "<=", "!=", "and", "or") and t not in ("/", "|") else kind
        elif t in PY_SOFT:
            kind = PY_SOFT[t]
        elif c in " \t\f":
            kind = "SPACE"
        elif t == "\n":
            kind = "LINE"
        elif c == "#" or t == "\\\n":
            kind = "SPACE" if c == "#" else "JOIN"
        elif t[-1] in "\"'" and len(t) > 1:
            kind = "BYTES" if "b" in t[: t.index(t[-1])].lower() else "STR"
        elif c.isdigit() or c == "." and len(t) > 1:
            kind = "NUM" if _PY_NUMBER.match(t) else "BAD"
        elif t.isidentifier():
            kind = "NAME"
        else:
            kind = "BAD"
        if len(self) < 500_000:
            self[t] = kind
        return kind


_py_kinds = _PythonKinds()


def python_kinds(text: str) -> list[str]:
    """Kinds of the tokens of a text, with NEWLINE, INDENT and DEDENT; BAD stands for what is no token."""
    out: list[str] = []
    add = out.append
    depth, indents = 0, [0]
    fresh, width = True, 0  # at the start of a line; its indentation
    kinds = _py_kinds
    for t in PY_TOKEN.findall(text.replace("\r\n", "\n").replace("\r", "\n") + "\n"):
        k = kinds[t]
        if k == "SPACE":
            if fresh and t[0] != "#":
                width = len(t.rpartition("\f")[2].expandtabs(8))
        elif k == "LINE":
            if not depth and not fresh:
                add("NEWLINE")
            if not depth:
                fresh, width = True, 0
        elif k == "JOIN":
            pass
        else:
            if fresh:
                if width > indents[-1]:
                    indents.append(width)
                    add("INDENT")
                else:
                    while width < indents[-1]:
                        indents.pop()
                        add("DEDENT")
                    if width != indents[-1]:
                        add("BAD")
                fresh = False
            if k in "([{":
                depth += 1
                if depth > PY_NESTING:
                    add("BAD")
                    return out
            elif k in ")]}" and depth:
                depth -= 1
            add(k)
    if depth:
        return out  # an open bracket: the end derivative is not nullable
    if out and out[-1] != "NEWLINE":
        add("NEWLINE")
    out.extend(["DEDENT"] * (len(indents) - 1))
    return out


PYTHON = r"""
file = ( stmt )* ;
n = NAME | MATCH | CASE | TYPE ;
stmt = simples NEWLINE | compound ;
simples = simple ( ';' simple )* ';'? ;
block = simples NEWLINE | NEWLINE INDENT stmt+ DEDENT ;
simple = exprstmt | 'pass' | 'break' | 'continue' | 'return' starlist? | 'raise' ( expr ( 'from' expr )? )? | 'global' n ( ',' n )* | 'nonlocal' n ( ',' n )* | 'del' targets | 'assert' expr ( ',' expr )? | importing | TYPE n typarams? '=' expr ;
importing = 'import' dotted ( 'as' n )? ( ',' dotted ( 'as' n )? )* | 'from' ( ( '.' | '...' )* dotted | ( '.' | '...' )+ ) 'import' ( '*' | names | '(' names ','? ')' ) ;
dotted = n ( '.' n )* ;
names = n ( 'as' n )? ( ',' n ( 'as' n )? )* ;
exprstmt = starlist | yielding | ( targets '=' )+ ( starlist | yielding ) | target AUG ( starlist | yielding ) | target ':' expr ( '=' ( starlist | yielding ) )? ;
yielding = 'yield' ( starlist | 'from' expr )? ;
targets = startarget ( ',' startarget )* ','? ;
startarget = '*'? target ;
target = atom ( call* ( attribute | subscript ) )+ | group ( call* ( attribute | subscript ) )+ | 'await' primary ( attribute | subscript ) | n | '(' targets? ')' | '[' targets? ']' ;
starlist = starexpr ( ',' starexpr )* ','? ;
starexpr = '*' binary | named ;
named = n ':=' expr | expr ;
expr = binary ( 'if' binary 'else' expr )? | 'lambda' lparams? ':' expr ;
binary = operand ( ( BIN | '+' | '-' | '*' | '**' | '/' | '@' | '|' | 'in' | 'is' 'not'? | 'not' 'in' ) operand )* ;
operand = ( 'not' | '-' | '+' | '~' | 'await' )* primary ;
primary = ( atom | group ) ( attribute | call | subscript )* ;
attribute = '.' n ;
call = '(' args? ')' ;
subscript = '[' sub ( ',' sub )* ','? ']' ;
sub = '*' binary | ':' expr? ( ':' expr? )? | named ( ':' expr? ( ':' expr? )? )? ;
args = arg ( ',' arg )* ','? ;
arg = n '=' expr | '*' expr | '**' expr | named comp? ;
atom = n | NUM | STR+ | BYTES+ | '...' | 'None' | 'True' | 'False' | '[' ( starexpr ( comp | ( ',' starexpr )* ','? ) )? ']' | '{' ( '**' binary pairs | '*' binary items | named ( ':' expr ( comp | pairs ) | comp | items ) )? '}' ;
pairs = ( ',' ( expr ':' expr | '**' binary ) )* ','? ;
items = ( ',' starexpr )* ','? ;
group = '(' ( yielding | '*' binary ',' starlist? | named ( comp | ',' starlist? )? )? ')' ;
comp = 'async'? 'for' targets 'in' binary ( 'async'? 'for' targets 'in' binary | 'if' ( binary | n ':=' binary | 'lambda' lparams? ':' expr ) )* ;
lparams = lparam ( ',' lparam )* ','? ;
lparam = n ( '=' expr )? | '*' n? | '**' n | '/' ;
params = param ( ',' param )* ','? ;
param = n ( ':' expr )? ( '=' expr )? | '*' ( n ( ':' starexpr )? )? | '**' n ( ':' expr )? | '/' ;
typarams = '[' ( '*' | '**' )? n ( ':' expr )? ( '=' expr )? ( ',' ( '*' | '**' )? n ( ':' expr )? ( '=' expr )? )* ','? ']' ;
compound = iff | whilee | forr | tryy | withh | function | classs | 'async' ( function | forr | withh ) | ( '@' named NEWLINE )+ ( function | classs | 'async' function ) | matching ;
iff = 'if' named ':' block ( 'elif' named ':' block )* ( 'else' ':' block )? ;
whilee = 'while' named ':' block ( 'else' ':' block )? ;
forr = 'for' targets 'in' starlist ':' block ( 'else' ':' block )? ;
tryy = 'try' ':' block ( 'finally' ':' block | ( 'except' '*'? ( expr ( ',' expr )* ( 'as' n )? )? ':' block )+ ( 'else' ':' block )? ( 'finally' ':' block )? ) ;
withh = 'with' ( item ( ',' item )* | '(' item ( ',' item )* ','? ')' ) ':' block ;
item = expr ( 'as' startarget )? ;
function = 'def' n typarams? '(' params? ')' ( '->' expr )? ':' block ;
classs = 'class' n typarams? ( '(' args? ')' )? ':' block ;
matching = MATCH starlist ':' NEWLINE INDENT ( CASE pattern ( ',' pattern )* ','? ( 'if' named )? ':' block )+ DEDENT ;
pattern = '*'? binary ( 'as' n )? ;
"""

# --- JavaScript and TypeScript -----------------------------------------------------------------------------------

# fixed values: reserved words, and words that are reserved in places only
JS_KEYWORDS = set("await break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield enum".split())
JS_CONTEXT = set("of as from get set async static let type interface declare namespace module abstract readonly keyof infer is satisfies implements private protected public override unique asserts accessor global".split())
_JS_OPERATORS = "( ) [ ] { } ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... @".split()
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`\"'\\]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\{[^{}`]*\}|`(?:[^`\\]|\\[\s\S])*`)*\})*`"
_BEFORE_REGEX = "".join(f"|(?<={re.escape(c)}{s})" for c in "(,=:[!&|?{};+-*%~^>\n" for s in ("", " "))[1:]
JS_TOKEN = re.compile(
    r"[ \t\f\v\u00a0\u2000-\u200a\u3000]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|" + _TEMPLATE + r"|#?[^\W\d][\w$]*|#?\$[\w$]*"
    r"|(?:0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)\w*|[\n\u2028\u2029]"
    r"|(?:" + _BEFORE_REGEX + r"|(?<=return )|(?<=typeof )|(?<=case ))/(?![*/ \n])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*(?!\w)"
    r"|>>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|[+\-*/%&|^]=|\*\*|<<|[\s\S]"
)
_JS_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*n?|0[oO][0-7]+(?:_[0-7]+)*n?|0[bB][01]+(?:_[01]+)*n?|(?:0|[1-9]\d*(?:_\d+)*)n|(?:(?:0|[1-9]\d*(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?)$")
_JS_GROUPS = {k: "ASG" for k in "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()} | {k: "BIN" for k in "<= >= == != === !== % ** << & ^ && || ??".split()} | {"instanceof": "BIN"}


class _ScriptKinds(dict):
    def __missing__(self, t: str) -> str:
        c = t[0]
        if t in _JS_GROUPS:
            kind = _JS_GROUPS[t]
        elif t in JS_KEYWORDS or t in JS_CONTEXT or t in _JS_OPERATORS:
            kind = t
        elif t in "\n\u2028\u2029":
            kind = "LINE"
        elif c.isspace() or t.startswith(("//", "/*")):
            kind = "LINES" if "\n" in t else "SPACE"
        elif c in "\"'" and len(t) > 1:
            kind = "STR"
        elif c == "`" and len(t) > 1:
            kind = "TPL"
        elif c == "/" and len(t) > 1:
            kind = "RE"
        elif c.isdigit() or c == "." and len(t) > 1:
            kind = "NUM" if _JS_NUMBER.match(t) else "BAD"
        elif c == "#" and len(t) > 1:
            kind = "PRIV"
        elif c.isalpha() or c in "_$":
            kind = "ID"
        else:
            kind = "BAD"
        if len(self) < 500_000:
            self[t] = kind
        return kind


_js_kinds = _ScriptKinds()
_HOLE = re.compile(r"\$\{((?:[^{}`\"'\\]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\{[^{}`]*\}|`(?:[^`\\]|\\[\s\S])*`)*)\}")
_SIMPLE = re.compile(r"\s*[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*$")


def script_kinds(text: str) -> tuple[list[str], list[str]]:
    """Kinds of the tokens of a text, LINE where lines end, and the expressions in its templates that are more than names."""
    out: list[str] = []
    holes: list[str] = []
    if text.startswith("#!"):
        text = text.partition("\n")[2]
    for t in JS_TOKEN.findall(text.replace("\r\n", "\n").replace("\r", "\n")):
        k = _js_kinds[t]
        if k == "SPACE":
            continue
        if k == "LINES":
            k = "LINE"
        elif k == "TPL" and "${" in t:
            holes += [h for h in _HOLE.findall(t) if not _SIMPLE.match(h)]
        if k != "LINE" or out and out[-1] != "LINE":
            out.append(k)
    return out, holes


_CONTEXT = " | ".join(f"'{w}'" for w in sorted(JS_CONTEXT))
_WORDS = " | ".join(f"'{w}'" for w in sorted(JS_KEYWORDS - {"instanceof"})) + " | BIN"

_SCRIPT = r"""
module = item* ;
id = ID | CONTEXT_WORDS ;
word = ID | CONTEXT_WORDS | RESERVED_WORDS ;
semi = ';' ;
item = importing | exporting | stmt ;
importing = 'import' TYPE_WORD? ( clause 'from' )? STR ( 'with' object )? semi ;
clause = id ( ',' ( specs | '*' 'as' id ) )? | specs | '*' 'as' id ;
specs = '{' ( spec ( ',' spec )* ','? )? '}' ;
spec = TYPE_WORD? ( word | STR ) ( 'as' ( word | STR ) )? ;
exporting = 'export' ( 'default' ( function | classs | ABSTRACT_CLASS assign semi ) | declaration | '*' ( 'as' ( word | STR ) )? 'from' STR semi | TYPE_WORD? specs ( 'from' STR )? semi EXPORT_MORE ) ;
declaration = vars semi | 'async'? 'function' '*'? id functionrest | DECORATORS 'class' id classrest MORE_DECLARATIONS ;
stmt = block | declaration | ';' | iff | forr | 'while' '(' list ')' stmt | 'do' stmt 'while' '(' list ')' ';'? | 'switch' '(' list ')' '{' ( 'case' list ':' stmt* | 'default' ':' stmt* )* '}' | 'return' list? semi | 'break' id? semi | 'continue' id? semi | 'throw' list semi | tryy | id ':' stmt | list_ns semi | 'debugger' semi ;
block = '{' stmt* '}' ;
vars = ( 'const' | 'let' | 'var' ) var ( ',' var )* ;
var = binding ANNOTATION ( '=' assign )? ;
iff = 'if' '(' list ')' stmt ( 'else' stmt )? ;
forr = 'for' 'await'? '(' ( ( vars | list )? ';' list? ';' list? | ( 'const' | 'let' | 'var' ) binding ( 'of' assign | 'in' list ) | lhs ( 'of' assign | 'in' list ) ) ')' stmt ;
tryy = 'try' block ( 'catch' ( '(' binding CATCH_ANNOTATION ')' )? block ( 'finally' block )? | 'finally' block ) ;
binding = id | '[' ( ','* element ( ',' element? )* )? ']' | '[' ',' + ']' | '{' ( bound ( ',' bound )* ','? )? '}' ;
element = '...'? binding ( '=' assign )? ;
bound = '...' id | id ( '=' assign )? | name ':' binding ( '=' assign )? ;
list = assign ( ',' assign )* ;
list_ns = assign_ns ( ',' assign )* ;
assign = id after_lhs | array after_lhs | object after_lhs | plain after_call | function after_call | classs after_call | prefixed | arrow | 'yield' '*'? assign? ;
assign_ns = id after_lhs | array after_lhs | plain after_call | prefixed | arrow | 'yield' '*'? assign? ;
prefixed = prefix+ primary trailer* tail ;
after_lhs = ( '=' | ASG ) assign | member after_lhs | call after_call NON_NULL_AFTER | tail ;
after_call = member after_lhs | call after_call NON_NULL_AFTER | tail ;
tail = ( '++' | '--' )? ( operator unary )* CAST ( '?' assign ':' assign )? ;
operator = BIN | '+' | '-' | '*' | '/' | '<' | '>' | '>' '>' | '>' '>' '>' | '|' | 'in' ;
prefix = '!' | '-' | '+' | '~' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' ;
unary = prefix* primary trailer* ( '++' | '--' )? ;
lhs = id after_member | ( plain | array | object ) trailer* member after_member ;
after_member = ( trailer* member )* NON_NULL ;
member = '.' ( word | PRIV ) | '?.' ( word | PRIV ) | '[' list ']' | '?.' '[' list ']' ;
call = '(' args ')' | '?.' '(' args ')' | TPL TYPED_CALL ;
trailer = member | call TRAILERS ;
args = ( spread ( ',' spread )* ','? )? ;
spread = '...'? assign ;
primary = id | array | object | plain | function | classs ;
plain = NUM | STR | TPL | RE | PRIV | JSX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' list ')' | 'new' ( '.' id | primary member* NEW_TYPES ( '(' args ')' )? ) | 'import' ( '(' args ')' | '.' id ) ;
array = '[' ','* ( spread ( ',' spread? )* )? ']' ;
object = '{' ( prop ( ',' prop )* ','? )? '}' ;
prop = '...' assign | id ( '=' assign )? | name ':' assign | ( 'get' | 'set' | 'async' | '*' )* name TYPE_PARAMETERS '(' params ')' RESULT block ;
name = word | STR | NUM | PRIV | '[' assign ']' ;
function = 'async'? 'function' '*'? id? functionrest ;
functionrest = TYPE_PARAMETERS '(' params ')' RESULT BODY ;
params = ( parameter ( ',' parameter )* ','? )? ;
parameter = PARAMETER_MODIFIERS '...'? binding OPTIONAL ANNOTATION ( '=' assign )? THIS_PARAMETER ;
arrow = 'async'? ( id | TYPE_PARAMETERS '(' params ')' RESULT ) '=>' ( block | assign ) ;
classs = DECORATORS 'class' id? classrest ;
classrest = TYPE_PARAMETERS ( 'extends' primary ( member | '(' args ')' )* TYPE_ARGUMENTS )? IMPLEMENTS '{' classmember* '}' ;
classmember = ';' | 'static' block | DECORATORS modifier* name TYPE_PARAMETERS '(' params ')' RESULT BODY | DECORATORS modifier* name FIELD_MARK ANNOTATION ( '=' assign )? semi MORE_MEMBERS ;
modifier = 'static' | 'async' | 'get' | 'set' | '*' | 'accessor' MORE_MODIFIERS ;
"""

_TYPES = r"""
type = '|'? '&'? inter ( ( '|' | BIN ) inter )* ( 'extends' type '?' type ':' type )? | id 'is' type | 'asserts' ( id | 'this' ) ( 'is' type )? | 'this' 'is' type ;
inter = ( 'keyof' | 'readonly' | 'unique' | 'infer' )* simple ( '[' type? ']' )* ;
simple = tname targs? | STR | NUM | '-' NUM | TPL | 'null' | 'true' | 'false' | 'void' | 'this' | 'typeof' ( id | 'this' ) ( '.' word )* targs? | 'import' '(' STR ')' ( '.' word )* targs? | '(' type ')' | ( 'abstract'? 'new' )? tparams? '(' params ')' '=>' type | '[' ( tuple ( ',' tuple )* ','? )? ']' | '{' tmember* '}' ;
tname = id ( '.' word )* ;
tuple = '...'? ( word '?'? ':' )? type '?'? ;
targs = '<' type ( ',' type )* ','? '>' ;
tparams = '<' tparam ( ',' tparam )* ','? '>' ;
tparam = ( 'const' | 'in' )* id ( 'extends' type )? ( '=' type )? ;
tmember = ( ( '+' | '-' )? 'readonly' )* ( ( 'get' | 'set' )? name '?'? ( ':' type | tparams? '(' params ')' ( ':' type )? )? | tparams? '(' params ')' ( ':' type )? | 'new' tparams? '(' params ')' ( ':' type )? | '[' id ( ':' type | 'in' type ( 'as' type )? ) ']' ( ( '+' | '-' )? '?' )? ( ':' type )? ) ( ',' | semi ) ;
more = 'interface' id tparams? ( 'extends' type ( ',' type )* )? '{' tmember* '}' | 'type' id tparams? '=' type semi | 'const'? 'enum' id '{' ( enumerator ( ',' enumerator )* ','? )? '}' | 'declare' ( declaration | 'global' block ) | ( 'namespace' | 'module' ) ( STR | id ( '.' id )* ) '{' item* '}' | 'abstract' classs ;
enumerator = ( word | STR ) ( '=' assign )? ;
"""

# what differs between the two languages: holes of the script grammar
_IN_JS = {
    "TYPE_WORD?": "", "ABSTRACT_CLASS": "|", "EXPORT_MORE": "", "MORE_DECLARATIONS": "", "CATCH_ANNOTATION": "", "ANNOTATION": "", "CAST": "", "NON_NULL_AFTER": "", "NON_NULL": "", "TYPED_CALL": "", "TRAILERS": "", "NEW_TYPES": "", "TYPE_PARAMETERS": "", "RESULT": "", "BODY": "block", "PARAMETER_MODIFIERS": "",
    "OPTIONAL": "", "THIS_PARAMETER": "", "DECORATORS": "", "TYPE_ARGUMENTS": "", "IMPLEMENTS": "", "FIELD_MARK": "", "MORE_MEMBERS": "", "MORE_MODIFIERS": "",
}
_IN_TS = {
    "TYPE_WORD?": "'type'?", "ABSTRACT_CLASS": "| 'abstract' classs | more |", "EXPORT_MORE": "| '=' assign semi | 'as' 'namespace' id semi | 'import' id '=' list semi", "MORE_DECLARATIONS": "| more", "CATCH_ANNOTATION": "( ':' type )?", "ANNOTATION": "( '!'? ':' type )?",
    "CAST": "( ( 'as' | 'satisfies' ) type ( operator unary )* )*", "NON_NULL_AFTER": "| '!' after_lhs", "NON_NULL": "'!'*", "TYPED_CALL": "| targs '(' args ')'", "TRAILERS": "| '!'", "NEW_TYPES": "targs?", "TYPE_PARAMETERS": "tparams?", "RESULT": "( ':' type )?", "BODY": "( block | semi )",
    "PARAMETER_MODIFIERS": "( '@' primary trailer* )* ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )*", "OPTIONAL": "'?'?", "THIS_PARAMETER": "| 'this' ':' type", "DECORATORS": "( '@' primary trailer* )*", "TYPE_ARGUMENTS": "targs?", "IMPLEMENTS": "( 'implements' type ( ',' type )* )?",
    "FIELD_MARK": "( '?' | '!' )?", "MORE_MEMBERS": "| modifier* '[' id ':' type ']' ':' type semi", "MORE_MODIFIERS": "| 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare'",
}


def _filled(holes: dict[str, str]) -> str:
    text = _SCRIPT
    for hole, by in holes.items():
        text = re.sub(r"(?<![A-Z_])" + re.escape(hole) + r"(?![A-Z_])", lambda m, by=by: by, text)
    return text.replace("CONTEXT_WORDS", _CONTEXT).replace("RESERVED_WORDS", _WORDS)


_built: dict[str, Grammar] = {}


def grammar(language: str) -> Grammar:
    """The grammar of a language, built once per process."""
    if language not in _built:
        if language == "python":
            _built[language] = Grammar(PYTHON, "file")
        elif language == "javascript":
            _built[language] = Grammar(_filled(_IN_JS), "module", ";", "}", "LINE")
        elif language == "typescript":
            _built[language] = Grammar(_filled(_IN_TS) + _TYPES, "module", ";", "}", "LINE")
        else:
            raise KeyError(language)
    return _built[language]
