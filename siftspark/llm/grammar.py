"""Grammars of fourteen languages, and the pairs of adjacent tokens they permit.

A grammar is written as rules over token classes. ``pairs`` derives which class may
stand directly after which: for every sequence ``a b`` in a rule the last symbols of
``a`` meet the first symbols of ``b`` (nullable parts are looked through). The result is
a small table (language, left, right), fixed by the grammar and not by the data.

Token classes: ``i`` identifier, ``n`` number, ``s`` string, ``B`` binary operator, ``S``
sign that is also unary, ``U`` prefix operator, ``I`` increment, ``A`` assignment, ``NL``
line end where lines count; keywords and other marks stand for themselves.
"""

from __future__ import annotations

import re
from functools import cache

_C_EXPR = """
expr = unary { binop unary } [ '?' expr ':' expr ] | unary 'A' expr
binop = 'B' | 'S' | '<' | '>' | '*' | '&' | %(binop)s
unary = { prefix } postfix
prefix = 'S' | 'U' | 'I' | '!' | %(prefix)s
postfix = primary { '.' name | '(' [ args ] ')' | '[' [ expr ] ']' | 'I' | %(suffix)s }
args = arg { ',' arg } [ ',' ]
arg = expr | %(arg)s
name = 'i'
primary = 'i' | 'n' | 's' | '(' expr ')' | %(primary)s
"""

_NONE = "'\\0'"


def _c(binop: str = _NONE, prefix: str = _NONE, suffix: str = _NONE, arg: str = _NONE, primary: str = _NONE) -> str:
    return _C_EXPR % {"binop": binop, "prefix": prefix, "suffix": suffix, "arg": arg, "primary": primary}


_JS_EXPR = _c(
    "'in' | 'instanceof' | 'of' | '/' | '??' ", "'typeof' | 'void' | 'delete' | 'await' | 'yield' | 'new' | 'async'", "'?.' name | '?.' '(' [ args ] ')' | '!' | s | '?.' '[' expr ']' | 'as' type | '=>' body", "'...' expr",
    "'this' | 'super' | 'null' | 'true' | 'false' | '[' [ list ] ']' | '{' [ props ] '}' | 'function' [ '*' ] [ 'i' ] params block | 'class' [ 'i' ] [ 'extends' expr ] '{' { member } '}' | 'import' | '(' ')' '=>' body | params [ ':' type ] '=>' body | '#' 'i'",
) + """
s = 's'
body = expr | block
list = [ ',' ] arg { ',' [ arg ] }
props = prop { ',' prop } [ ',' ]
prop = key ':' expr | 'i' [ 'A' expr ] | '...' expr | [ 'async' | 'get' | 'set' | 'static' ] [ '*' ] key params block
key = 'i' | 's' | 'n' | '[' expr ']' | kw
kw = 'default' | 'in' | 'of' | 'get' | 'set' | 'new' | 'delete' | 'return' | 'import' | 'from' | 'type' | 'static' | 'async' | 'await' | 'for' | 'if' | 'class' | 'function' | 'this' | 'null' | 'true' | 'false' | 'catch' | 'finally' | 'case' | 'do' | 'try' | 'switch' | 'var' | 'let' | 'const' | 'export' | 'extends' | 'yield' | 'with' | 'as' | 'typeof' | 'void' | 'throw' | 'while' | 'else' | 'break' | 'continue' | 'super' | 'instanceof'
name = 'i' | kw | '#' 'i'
params = '(' [ param { ',' param } [ ',' ] ] ')'
param = [ '...' ] pattern [ typed ] [ 'A' expr ]
pattern = 'i' | '[' [ ',' ] [ pattern { ',' [ pattern ] } ] ']' | '{' [ pprop { ',' pprop } [ ',' ] ] '}' | 'this'
pprop = key [ ':' pattern ] [ 'A' expr ] | '...' 'i' | 'i' [ 'A' expr ]
block = '{' { stmt } '}'
end = ';' | 'NL' | 'EOF'
nl = { 'NL' }
stmt = ';' | 'NL' | block nl | expr [ ',' expr ] end | ( 'const' | 'let' | 'var' ) vars end | 'if' '(' expr ')' nl stmt [ 'else' nl stmt ] | 'while' '(' expr ')' nl stmt | 'do' nl stmt nl 'while' '(' expr ')' end | 'for' [ 'await' ] '(' [ init ] ';' [ expr { ',' expr } ] ';' [ expr { ',' expr } ] ')' nl stmt | 'for' [ 'await' ] '(' [ 'const' | 'let' | 'var' ] pattern ( 'of' | 'in' ) expr ')' nl stmt | 'return' [ expr ] end | 'break' [ 'i' ] [ end ] | 'continue' [ 'i' ] [ end ] | 'throw' expr end | 'try' block nl [ 'catch' [ '(' pattern [ typed ] ')' ] block ] nl [ 'finally' block ] | 'switch' '(' expr ')' '{' { 'case' expr ':' { stmt } | 'default' ':' { stmt } | 'NL' } '}' | 'i' ':' stmt | fn | cls | 'import' imp end | 'export' exp | 'debugger' end | 's' end
init = ( 'const' | 'let' | 'var' ) vars | expr { ',' expr }
vars = var { ',' var }
var = pattern [ typed ] [ 'A' expr ]
fn = [ 'async' ] 'function' [ '*' ] 'i' [ generics ] params [ typed ] ( block | end )
cls = [ 'abstract' ] 'class' 'i' [ generics ] [ 'extends' expr [ targs ] ] [ 'implements' type { ',' type } ] '{' { member } '}'
member = ';' | 'NL' | { mod } ( key | '#' 'i' ) [ '?' | '!' ] [ generics ] ( params [ typed ] ( block | end ) | [ typed ] [ 'A' expr ] end ) | 'static' block
mod = 'static' | 'async' | 'get' | 'set' | '*'
imp = 's' | impl 'from' 's' | 'type' impl 'from' 's'
impl = 'i' [ ',' names ] | names | '*' 'as' 'i'
names = '{' [ spec { ',' spec } [ ',' ] ] '}'
spec = [ 'type' ] name [ 'as' name ]
exp = 'default' ( expr end | fn | cls | 'async' 'function' params block ) | names [ 'from' 's' ] end | '*' [ 'as' 'i' ] 'from' 's' end | stmt
program = [ '#!' ] { stmt } 'EOF'
"""
_JS = _JS_EXPR.replace("| 'as' type ", "").replace("[ typed ]", "").replace("[ ':' type ]", "").replace("[ generics ]", "").replace("[ targs ]", "").replace("[ 'implements' type { ',' type } ]", "").replace("[ '?' | '!' ]", "").replace("| '!' | s |", "| s |").replace("[ 'abstract' ] ", "")
_TS = _JS_EXPR.replace("'as' type |", "( 'as' | 'satisfies' ) type | 'as' 'const' | targs '(' [ args ] ')' |").replace("primary = 'i'", "primary = generics params [ typed ] '=>' body | '<' type '>' unary | 'i'").replace("mod = 'static'", "mod = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override' | decorator | 'static'").replace("pattern = 'i'", "pattern = [ 'public' | 'private' | 'protected' | 'readonly' ] 'i' [ '?' | '!' ]").replace("| 'debugger' end", "| 'debugger' end | 'type' 'i' [ generics ] 'A' type end | [ 'const' ] 'enum' 'i' '{' [ key [ 'A' expr ] { ',' key [ 'A' expr ] } [ ',' ] ] '}' | 'interface' 'i' [ generics ] [ 'extends' type { ',' type } ] tbody | 'declare' stmt | ( 'namespace' | 'module' ) ( 'i' | 's' ) block | decorator") + """
typed = ':' type
decorator = '@' 'i' { '.' 'i' } [ '(' [ args ] ')' ] nl
generics = '<' gen { ',' gen } [ ',' ] '>'
gen = [ 'const' ] 'i' [ 'extends' type ] [ 'A' type ]
targs = '<' type { ',' type } '>'
type = [ 'B' | '&' ] tone { ( 'B' | '&' ) tone } | tone 'extends' tone '?' type ':' type | 'asserts' 'i' [ 'is' type ] | 'i' 'is' type
tone = tbase { '[' [ type ] ']' } | ( 'keyof' | 'readonly' | 'typeof' | 'infer' | 'unique' ) tone | [ 'new' ] params '=>' type
tbase = 'i' { '.' 'i' } [ targs ] | 's' | 'n' | 'S' 'n' | 'null' | 'void' | 'true' | 'false' | 'this' | '(' type ')' | '[' [ type { ',' type } ] ']' | tbody | 'import' '(' 's' ')'
tbody = '{' { tmember } [ [ 'readonly' ] key [ '?' ] typed ] '}'
tmember = ';' | ',' | 'NL' | [ 'readonly' ] ( key | '[' 'i' ':' type ']' | '[' 'i' 'in' type ']' ) [ '?' ] ( [ generics ] params [ typed ] | typed ) ( ';' | ',' | 'NL' ) | params typed ( ';' | ',' | 'NL' )
"""

_JAVA = _c("'instanceof'", "'new' | '(' type ')'", "'::' ( 'i' | 'new' ) | '->' lam | block | ',' | '.' '<' type { ',' type } '>' 'i' | '.' 'new'", _NONE, "'this' | 'super' | 'null' | 'true' | 'false' | '(' ')' '->' lam | '(' 'i' { ',' 'i' } ')' '->' lam | '{' [ expr { ',' expr } [ ',' ] ] '}' | type | ptype [ '[' ']' ] | 'switch' '(' expr ')' '{' { sw } '}'") + """
lam = expr | block
name = 'i' | 'class' | 'new' | 'this' | 'super'
ptype = 'int' | 'long' | 'double' | 'float' | 'boolean' | 'char' | 'byte' | 'short' | 'void'
type = ( 'i' | ptype ) { '.' 'i' } [ '<' [ targ { ',' targ } ] '>' ] { '.' 'i' } { '[' ']' } [ '...' ]
targ = type | '?' [ ( 'extends' | 'super' ) type ]
ann = '@' 'i' { '.' 'i' } [ '(' [ aargs ] ')' ]
aargs = expr | 'i' 'A' expr { ',' 'i' 'A' expr }
mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'synchronized' | 'native' | 'volatile' | 'transient' | 'default' | 'strictfp' | 'sealed' | ann
generics = '<' 'i' [ 'extends' type { '&' type } ] { ',' 'i' [ 'extends' type ] } '>'
param = { mod } type ( 'i' | 'this' ) { '[' ']' }
params = '(' [ param { ',' param } ] ')'
block = '{' { stmt } '}'
vars = 'i' { '[' ']' } [ 'A' expr ] { ',' 'i' { '[' ']' } [ 'A' expr ] }
stmt = ';' | block | expr ';' | { mod } type vars ';' | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' [ { mod } type vars | expr { ',' expr } ] ';' [ expr ] ';' [ expr { ',' expr } ] ')' stmt | 'for' '(' { mod } type 'i' ':' expr ')' stmt | 'return' [ expr ] ';' | ( 'break' | 'continue' ) [ 'i' ] ';' | 'throw' expr ';' | 'try' [ '(' { mod } type 'i' 'A' expr { ';' type 'i' 'A' expr } [ ';' ] ')' ] block { 'catch' '(' { mod } type { 'B' type } 'i' ')' block } [ 'finally' block ] | 'switch' '(' expr ')' '{' { sw } '}' | 'synchronized' '(' expr ')' block | 'assert' expr [ ':' expr ] ';' | 'yield' expr ';' | 'i' ':' stmt | cls | 'var' vars ';'
sw = ( 'case' label { ',' label } [ 'when' expr ] | 'default' )
label = expr | { mod } type 'i' | type '(' [ label { ',' label } ] ')' | 'default' ( ':' { stmt } | '->' ( stmt | expr ';' ) )
cls = { mod } ( ( 'class' | 'interface' | 'record' | '@' 'interface' ) 'i' [ generics ] [ params ] [ 'extends' type { ',' type } ] [ 'implements' type { ',' type } ] [ 'permits' type ] '{' { member } '}' | 'enum' 'i' [ 'implements' type { ',' type } ] '{' [ 'i' [ '(' [ args ] ')' ] [ block ] { ',' 'i' [ '(' [ args ] ')' ] } [ ',' ] ] [ ';' { member } ] '}' )
member = ';' | cls | [ 'static' ] block | { mod } [ generics ] [ type ] 'i' params { '[' ']' } [ 'throws' type { ',' type } ] ( block | ';' | 'default' expr ';' ) | { mod } type vars ';'
program = { mod } [ 'package' 'i' { '.' 'i' } ';' ] { 'import' [ 'static' ] 'i' { '.' ( 'i' | '*' ) } ';' } { cls | ';' } 'EOF'
"""

_CS = _c("'is' | 'as' | 'in' | '??' | '..' | '^' | 'and' | 'or' | 'is' 'not' | 'and' 'not' | 'or' 'not'", "'*' | '&' | '^' | 'new' | 'await' | '(' type ')' | 'ref' | 'out' | 'in' | 'throw' | '..'", "'?.' name | '=>' lam | '!' | block | 'switch' block | 'with' block", "'i' ':' expr | ( 'out' | 'ref' ) ( 'var' | type ) 'i'", "'this' | 'base' | 'null' | 'true' | 'false' | 'default' | 'typeof' '(' type ')' | 'nameof' | '(' [ 'i' { ',' 'i' } ] ')' '=>' lam | '(' type 'i' { ',' type 'i' } ')' '=>' lam | '{' [ expr { ',' expr } [ ',' ] ] '}' | '[' [ expr { ',' expr } ] ']' | type | query | pattern | 'delegate' [ params ] block | '(' expr { ',' expr } ')' | 'async'") + """
lam = expr | block
query = 'from' [ type ] 'i' 'in' expr { clause }
clause = 'where' expr | 'orderby' expr [ 'ascending' | 'descending' ] { ',' expr } | 'select' expr [ 'into' 'i' ] | 'join' [ type ] 'i' 'in' expr 'on' expr 'equals' expr [ 'into' 'i' ] | 'let' 'i' 'A' expr | 'group' expr 'by' expr [ 'into' 'i' ] | 'from' 'i' 'in' expr
pattern = [ 'not' ] ( ( '<' | '>' | 'B' ) expr | [ type ] '{' [ pp { ',' pp } ] '}' [ 'i' ] | type 'i' | 'null' ) [ 'when' expr ]
pp = name ':' ( pattern | expr )
ptype = 'int' | 'long' | 'double' | 'float' | 'bool' | 'char' | 'byte' | 'short' | 'void' | 'string' | 'object' | 'decimal' | 'uint' | 'ulong' | 'var' | 'dynamic' | 'ushort' | 'sbyte'
type = ( 'i' | ptype ) { '.' 'i' } [ '<' [ type { ',' type } ] '>' ] { '.' 'i' } [ '?' ] { '[' { ',' } ']' }
attr = '[' [ 'i' ':' ] 'i' { '.' 'i' } [ '(' [ args ] ')' ] ']'
mod = 'public' | 'private' | 'protected' | 'internal' | 'static' | 'readonly' | 'const' | 'abstract' | 'virtual' | 'override' | 'sealed' | 'async' | 'partial' | 'extern' | 'unsafe' | 'new' | 'required' | 'volatile' | attr
generics = '<' 'i' { ',' 'i' } '>'
where = 'where' 'i' ':' cons { ',' cons }
cons = type | 'class' | 'struct' | 'new' '(' ')'
param = { attr } [ 'this' | 'ref' | 'out' | 'in' | 'params' ] type 'i' [ 'A' expr ]
params = '(' [ param { ',' param } ] ')'
block = '{' { stmt } '}'
vars = 'i' [ 'A' expr ] { ',' 'i' [ 'A' expr ] }
stmt = ';' | block | expr ';' | { mod } type vars ';' | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' [ type vars | expr ] ';' [ expr ] ';' [ expr ] ')' stmt | [ 'await' ] 'foreach' '(' type ( 'i' | '(' 'i' { ',' 'i' } ')' ) 'in' expr ')' stmt | 'return' [ expr ] ';' | 'break' ';' | 'continue' ';' | 'throw' [ expr ] ';' | 'try' block { 'catch' [ '(' type [ 'i' ] ')' ] [ 'when' '(' expr ')' ] block } [ 'finally' block ] | 'switch' '(' expr ')' '{' { ( 'case' expr [ 'i' ] [ 'when' expr ] | 'default' ) ':' { stmt } } '}' | ( 'checked' | 'unchecked' | 'unsafe' ) block | 'fixed' '(' type vars ')' stmt | type '*' 'i' [ 'A' expr ] ';' | [ 'await' ] 'using' ( '(' ( type vars | expr ) ')' stmt | type vars ';' ) | 'lock' '(' expr ')' stmt | 'yield' ( 'return' expr | 'break' ) ';' | 'goto' ( 'i' | 'case' expr | 'default' ) ';' | 'i' ':' stmt | { mod } type 'i' [ generics ] params { where } ( block | '=>' expr ';' )
cls = { mod } ( 'class' | 'struct' | 'interface' | 'record' ) 'i' [ generics ] [ params ] [ ':' type { ',' type } ] { where } ( '{' { member } '}' | ';' ) | { mod } 'enum' 'i' [ ':' type ] '{' [ 'i' [ 'A' expr ] { ',' 'i' [ 'A' expr ] } [ ',' ] ] '}'
acc = { mod } ( 'get' | 'set' | 'init' | 'add' | 'remove' ) ( ';' | block | '=>' expr ';' )
member = ';' | cls | { mod } [ 'event' ] type vars ';' | { mod } [ type ] 'i' [ generics ] params { where } [ ':' ( 'this' | 'base' ) '(' [ args ] ')' ] ( block | ';' | '=>' expr ';' ) | { mod } type ( 'i' | 'this' '[' param ']' ) ( '{' { acc } '}' [ 'A' expr ';' ] | '=>' expr ';' ) | { mod } 'delegate' type 'i' params ';'
item = 'using' [ 'static' ] [ 'i' 'A' ] 'i' { '.' 'i' } ';' | 'namespace' 'i' { '.' 'i' } ( '{' { item } '}' | ';' ) | cls | ';' | stmt
program = { attr } { item } 'EOF'
"""

_CC = _c("'->' '*' | '.' '*'", "'*' | '&' | 'sizeof' [ '...' ] | '(' type ')' | 'new' | 'delete' | 'co_await' | 'throw'", "'->' 'i' | '::' name | '{' [ args ] '}' | '...'", "type | '.' 'i' 'A' expr", "'{' [ init { ',' init } [ ',' ] ] '}' | 's' { 's' } | 'true' | 'false' | 'nullptr' | 'this' | type | 'sizeof' '(' type ')' | lambda | '::' 'i' | 'operator' op | ( 'static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast' ) '<' type '>' '(' expr ')'") + """
init = expr | '.' 'i' 'A' expr | '[' expr ']' 'A' expr
name = 'i' | '~' 'i' | 'template' 'i' | 'operator' op
op = 'B' | 'S' | '*' | '&' | '<' | '>' | '(' ')' | '[' ']' | 'A' | 'I' | '!'
lambda = '[' [ cap { ',' cap } ] ']' [ params [ 'mutable' ] [ '->' type ] ] block
cap = '&' [ 'i' ] | 'A' | 'this' | 'i' [ 'A' expr ]
qual = 'const' | 'volatile' | 'static' | 'extern' | 'inline' | 'register' | 'constexpr' | 'virtual' | 'explicit' | 'friend' | 'typename' | 'mutable' | 'thread_local' | 'restrict' | 'consteval' | '_Static'
ptype = 'int' | 'long' | 'double' | 'float' | 'bool' | 'char' | 'short' | 'void' | 'unsigned' | 'signed' | 'auto' | 'wchar_t'
ttype = ptype { ptype } | [ 'struct' | 'enum' | 'union' | 'class' ] qname | 'decltype' '(' expr ')'
qname = [ '::' ] 'i' [ targs ] { '::' ( 'i' | '~' 'i' ) [ targs ] }
targs = '<' [ targ { ',' targ } ] '>'
targ = type | expr
type = { qual } ttype { qual } { ptr } [ '...' ]
ptr = ( '*' | '&' | 'B' ) { 'const' | 'volatile' | 'restrict' }
decl = { ptr } ( 'i' | '::' '*' 'i' | qname | '(' { ptr } decl ')' ) { '[' [ expr ] ']' | params | ':' 'n' }
param = type [ decl ] [ 'A' expr ] | '...'
params = '(' [ param { ',' param } ] ')'
vars = decl [ 'A' expr | '{' [ args ] '}' | '(' args ')' ] { ',' decl [ 'A' expr ] }
attr = '[' '[' 'i' [ '(' args ')' ] ']' ']'
block = '{' { stmt } '}'
stmt = ';' | block | expr { ',' expr } ';' | type vars ';' | 'if' [ 'constexpr' ] '(' [ type vars ';' ] ( expr | type vars ) ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' [ type vars | expr ] ';' [ expr ] ';' [ expr { ',' expr } ] ')' stmt | 'for' '(' type ( 'i' | '[' 'i' { ',' 'i' } ']' ) ':' expr ')' stmt | 'return' [ expr ] ';' | 'break' ';' | 'continue' ';' | 'goto' 'i' ';' | 'switch' '(' expr ')' stmt | 'case' expr ':' | 'default' ':' | 'i' ':' | 'try' block { 'catch' '(' ( param | '...' ) ')' block } | 'throw' [ expr ] ';' | item
tail = { 'const' | 'noexcept' | 'override' | 'final' | '&' | '->' type | 'noexcept' '(' expr ')' } [ 'A' ( 'n' | 'default' | 'delete' ) ]
fn = { qual } [ type ] ( decl | qname | { ptr } qname | { ptr } 'operator' op | '~' 'i' ) params tail [ ':' 'i' ( '(' [ args ] ')' | '{' [ args ] '}' ) { ',' 'i' '(' [ args ] ')' } ] ( block | ';' )
item = ';' | fn | type [ vars ] ';' | 'typedef' type [ '{' { member } '}' ] decl { ',' decl } ';' | { qual } ( 'struct' | 'union' | 'class' ) [ 'i' ] [ targs ] [ 'final' ] [ ':' base { ',' base } ] '{' { member } '}' [ vars ] ';' | 'enum' [ 'class' | 'struct' ] [ 'i' ] [ ':' type ] '{' [ 'i' [ 'A' expr ] { ',' 'i' [ 'A' expr ] } [ ',' ] ] '}' [ decl ] ';' | [ 'inline' ] 'namespace' [ 'i' { '::' 'i' } ] '{' { item } '}' | 'using' [ 'namespace' ] [ 'i' 'A' ] type ';' | 'template' '<' [ tparam { ',' tparam } ] '>' item | 'extern' 's' ( '{' { item } '}' | item ) | 'static_assert' '(' args ')' ';' | attr item
base = [ 'virtual' ] [ 'public' | 'private' | 'protected' ] qname
tparam = ( 'typename' | 'class' ) [ '...' ] [ 'i' ] [ 'A' type ] | type 'i' [ 'A' expr ]
member = item | ( 'public' | 'private' | 'protected' ) ':' | type decl ':' expr ';'
program = { item } 'EOF'
"""

_RS = _c("'as' | '..' | '/'", "'*' | '&' | 'mut' | 'move' | 'ref' | 'await' | '..'", "'?' | '::' ( 'i' | '<' type { ',' type } '>' ) | '!' group | '{' [ fields ] '}' | 'as' type | '..'", _NONE, "'self' | 'Self' | 'crate' | 'super' | 'true' | 'false' | '[' [ expr ( { ',' expr } [ ',' ] | ';' expr ) ] ']' | '(' [ expr { ',' expr } [ ',' ] ] ')' | block | 'unsafe' block | ifx | 'match' expr '{' arms '}' | loops | closure | 'return' [ expr ] | 'break' [ expr ] | 'continue' | 'async' [ 'move' ] block | '<' type '>' '::' 'i' | 'life'") + """
ifx = 'if' cond block [ 'else' ( block | ifx ) ]
cond = expr | 'let' pat 'A' expr
loops = [ 'life' ':' ] ( 'loop' block | 'while' cond block | 'for' pat 'in' expr block )
closure = 'B' [ pat { ',' pat } ] 'B' [ '->' type ] expr | 'B' expr | 'B' pat ':' type { ',' pat ':' type } 'B' expr
fields = 'i' [ ':' expr ] { ',' 'i' [ ':' expr ] } [ ',' ] [ '..' expr ]
group = '(' [ args ] ')' | '[' [ args | expr ';' expr ] ']' | '{' [ args ] '}'
name = 'i' | 'n' | 'await'
arms = { arm } [ pat [ 'if' expr ] '=>' expr ]
arm = pat { 'B' pat } [ 'if' expr ] '=>' ( expr ',' | block [ ',' ] )
pat = [ 'B' ] patone { 'B' patone }
patone = [ 'ref' ] [ 'mut' ] 'i' [ '@' pat ] | 'n' | 's' | 'S' 'n' | 'true' | 'false' | '_' | '..' | path [ '(' [ pat { ',' pat } [ ',' ] ] ')' | '{' [ fpat { ',' fpat } [ ',' ] ] '}' ] | '(' [ pat { ',' pat } [ ',' ] ] ')' | '[' [ pat { ',' pat } ] ']' | ( '&' | 'B' ) [ 'mut' ] pat | 'n' '..' 'n' | 'self'
fpat = 'i' [ ':' pat ] | 'ref' 'i' | '..'
path = ( 'i' | 'self' | 'Self' | 'crate' | 'super' ) { '::' ( 'i' | '<' targs '>' ) }
type = ( '&' | 'B' ) [ 'life' ] [ 'mut' ] type | '*' ( 'const' | 'mut' ) type | path [ '<' targs '>' ] { '::' 'i' [ '<' targs '>' ] } | '[' type [ ';' expr ] ']' | '(' [ type { ',' type } [ ',' ] ] ')' | ( 'dyn' | 'impl' ) bound { 'S' bound } | 'fn' '(' [ type { ',' type } ] ')' [ '->' type ] | '!' | '_'
bound = 'life' | [ '?' ] type [ '(' [ type ] ')' [ '->' type ] ] | 'for' '<' 'life' '>' type
targs = targ { ',' targ } [ ',' ]
targ = type | 'life' | 'i' 'A' type | 'n' | block
generics = '<' gen { ',' gen } [ ',' ] '>'
gen = 'life' [ ':' bound ] | [ 'const' ] 'i' [ ':' bound { 'S' bound } ] [ 'A' type ]
where = 'where' type ':' bound { 'S' bound } { ',' type ':' bound } [ ',' ]
attr = '#' [ '!' ] '[' expr ']'
vis = 'pub' [ '(' ( 'crate' | 'super' | 'self' | 'in' path ) ')' ]
params = '(' [ param { ',' param } [ ',' ] ] ')'
param = [ '&' ] [ 'life' ] [ 'mut' ] 'self' [ ':' type ] | pat ':' type
fn = [ 'const' | 'async' | 'unsafe' | 'extern' [ 's' ] ] 'fn' 'i' [ generics ] params [ '->' type ] [ where ] ( block | ';' )
block = '{' { stmt } [ expr ] '}'
stmt = ';' | 'let' pat [ ':' type ] [ 'A' expr [ 'else' block ] ] ';' | expr ';' | block | ifx | 'match' expr '{' arms '}' | loops | item | 'unsafe' block | 'i' '!' group [ ';' ]
item = attr | [ vis ] ( fn | 'use' use ';' | 'mod' 'i' ( ';' | '{' { item } '}' ) | 'struct' 'i' [ generics ] [ where ] ( ';' | '(' [ [ vis ] type { ',' [ vis ] type } ] ')' ';' | '{' [ { attr } [ vis ] 'i' ':' type { ',' { attr } [ vis ] 'i' ':' type } [ ',' ] ] '}' ) | 'enum' 'i' [ generics ] '{' [ var { ',' var } [ ',' ] ] '}' | [ 'unsafe' ] 'impl' [ generics ] [ '!' ] type [ 'for' type ] [ where ] '{' { item } '}' | [ 'unsafe' ] 'trait' 'i' [ generics ] [ ':' bound { 'S' bound } ] [ where ] '{' { item } '}' | 'type' 'i' [ generics ] [ ':' bound ] [ 'A' type ] ';' | ( 'const' | 'static' [ 'mut' ] ) ( 'i' | '_' ) ':' type [ 'A' expr ] ';' | 'extern' 'crate' 'i' ';' | 'extern' [ 's' ] '{' { item } '}' ) | 'i' '!' [ 'i' ] group [ ';' ]
var = { attr } 'i' [ '(' [ type { ',' type } ] ')' | '{' [ 'i' ':' type { ',' 'i' ':' type } [ ',' ] ] '}' ] [ 'A' expr ]
use = [ '::' ] ( 'i' | 'self' | 'crate' | 'super' ) { '::' ( 'i' | 'self' | 'super' ) } [ '::' ( '*' | '{' [ use { ',' use } [ ',' ] ] '}' ) ] [ 'as' ( 'i' | '_' ) ]
program = { item } 'EOF'
"""

_GO = _c("'^'", "'<-' | '*' | '&' | '^'", "'(' 'type' ')' | '{' [ elems ] '}' | '[' [ expr ] ':' [ expr ] ']' | '...'", "type", "'func' params [ result ] block | ctype '{' [ elems ] '}' | ctype | ctype '(' expr ')' | 'struct' '{' '}' '{' '}' | 'interface' '{' '}' | 'chan' type") + """
name = 'i' | '(' ( type | 'type' ) ')'
ctype = '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type
elems = elem { ',' elem } [ ',' ]
elem = [ ( expr | '{' [ elems ] '}' ) ':' ] ( expr | '{' [ elems ] '}' )
type = { '*' } ( 'i' [ '.' 'i' ] [ '[' type { ',' type } ']' ] | '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type | 'func' params [ result ] | 'struct' '{' { fieldd } '}' | 'interface' '{' { imember } '}' | [ '<-' ] 'chan' [ '<-' ] type | '(' type ')' )
fieldd = end | 'i' { ',' 'i' } type [ 's' ] end | [ '*' ] 'i' [ '.' 'i' ] [ 's' ] end
imember = end | 'i' params [ result ] end | [ '~' ] type { 'B' [ '~' ] type } end
params = '(' [ param { ',' param } [ ',' ] ] ')'
param = [ 'i' ] [ '...' ] type
result = type | params
end = ';' | 'NL' | 'EOF'
exprs = expr { ',' expr }
block = '{' { stmt } '}'
simple = exprs | exprs 'A' exprs | expr '<-' expr
stmt = end | [ simple ] end | 'var' vard end | 'const' vard end | 'type' typed end | 'return' [ exprs ] end | 'if' [ simple ';' ] expr block [ 'else' ( stmt | block ) ] | 'for' [ [ simple ] ';' [ expr ] ';' [ simple ] | [ exprs 'A' ] 'range' expr | expr ] block | 'switch' [ simple ';' ] [ simple ] '{' { cases } '}' | 'select' '{' { cases } '}' | 'go' expr end | 'defer' expr end | ( 'break' | 'continue' | 'goto' ) [ 'i' ] [ end ] | 'fallthrough' [ end ] | block | 'i' ':' end | 'return' [ exprs ] | simple
cases = end | ( 'case' ( exprs | simple | type { ',' type } ) | 'default' ) ':' { stmt }
vard = 'i' { ',' 'i' } [ type ] [ 'A' exprs ] | '(' { end | 'i' { ',' 'i' } [ type ] [ 'A' exprs ] end } ')'
typed = 'i' [ '[' gen { ',' gen } ']' ] [ 'A' ] type | '(' { end | 'i' [ 'A' ] type end } ')'
gen = 'i' { ',' 'i' } [ '~' | 'U' ] type { 'B' [ '~' | 'U' ] type }
imp = [ 'i' | '.' ] 's'
item = end | 'import' ( imp end | '(' { imp end | end } ')' end ) | 'func' [ params ] 'i' [ '[' gen { ',' gen } ']' ] params [ result ] ( block end | end ) | 'var' vard end | 'const' vard end | 'type' typed end
program = { 'NL' } 'package' 'i' end { item } 'EOF'
"""

_PHP = _c("'instanceof' | '.' | '?' ':' | 'and' | 'or' | 'xor' | '??'", "'new' | 'clone' | 'print' | 'throw' | '@' | '(' 'i' ')' | 'await' | 'include' | 'require' | 'require_once' | 'include_once' | '&'", "'->' name | '?->' name | '::' ( name | 'class' ) | '{' expr '}' | '\\\\' 'i'", "'...' [ expr ] | 'i' ':' expr", "'array' '(' [ elems ] ')' | '[' [ elems ] ']' | [ 'static' ] 'function' [ '&' ] params [ 'use' params ] [ ':' type ] block | [ 'static' ] 'fn' params [ ':' type ] '=>' expr | 'isset' | 'empty' | 'list' '(' elems ')' | 'static' | 'v' | '\\\\' 'i' | 'match' '(' expr ')' '{' [ marm { ',' marm } [ ',' ] ] '}' | 'exit' | 'die' | 'null' | 'true' | 'false' | 'class' params [ 'extends' type ] [ 'implements' type { ',' type } ] cbody | 'yield' [ 'from' ] [ expr [ '=>' expr ] ] | 'throw' expr") + """
name = 'i' | 'v' | 'class' | '{' expr '}' | 'list' | 'print' | 'default' | 'new' | 'empty'
marm = ( expr { ',' expr } | 'default' ) '=>' expr
elems = [ elem ] { ',' [ elem ] }
elem = [ expr '=>' ] [ '&' | '...' ] expr
type = [ '?' ] ( 'i' | 'array' | 'static' | 'null' | 'false' | 'callable' ) { '\\\\' 'i' } { ( 'B' | '&' ) ( 'i' | 'null' | 'array' ) } | '\\\\' 'i' { '\\\\' 'i' }
param = { mod } [ type ] [ '&' ] [ '...' ] 'v' [ 'A' expr ]
params = '(' [ param { ',' param } [ ',' ] ] ')'
block = '{' { stmt } '}'
mod = 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'final' | 'readonly' | 'var'
sub = stmt | ':' { stmt }
stmt = ';' | block | expr ( ';' | '?>' ) | 'goto' 'i' ';' | 'i' ':' | 'echo' expr { ',' expr } ';' | 'if' '(' expr ')' sub { ( 'elseif' | 'else' 'if' ) '(' expr ')' sub } [ 'else' sub ] [ ( 'endif' | 'endforeach' | 'endwhile' | 'endfor' ) ';' ] | 'while' '(' expr ')' sub | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' [ args ] ';' [ args ] ';' [ args ] ')' sub | 'foreach' '(' expr 'as' [ expr '=>' ] [ '&' ] expr ')' sub | 'switch' '(' expr ')' '{' { ( 'case' expr | 'default' ) ( ':' | ';' ) { stmt } } '}' | 'return' [ expr ] ';' | ( 'break' | 'continue' ) [ 'n' ] ';' | 'try' block { 'catch' '(' type [ 'v' ] ')' block } [ 'finally' block ] | 'global' 'v' { ',' 'v' } ';' | 'static' 'v' [ 'A' expr ] ';' | 'unset' '(' args ')' ';' | 'const' 'i' 'A' expr ';' | fn | cls | 'use' usen ';' | 'namespace' 'i' { '\\\\' 'i' } ( ';' | block ) | 'declare' '(' 'i' 'A' 'n' ')' ( ';' | block ) | '?>' | 'open' | attr
attr = '#' '[' expr ']'
usen = [ 'function' | 'const' ] [ '\\\\' ] 'i' { '\\\\' 'i' } [ 'as' 'i' ] { ',' 'i' { '\\\\' 'i' } } [ '\\\\' '{' 'i' { ',' 'i' } '}' ]
fn = 'function' [ '&' ] 'i' params [ ':' type ] block
cls = { mod } ( 'class' | 'interface' | 'trait' | 'enum' ) 'i' [ ':' type ] [ 'extends' type { ',' type } ] [ 'implements' type { ',' type } ] cbody
cbody = '{' { member } '}'
member = { mod } 'function' [ '&' ] name params [ ':' type ] ( block | ';' ) | { mod } [ type ] 'v' [ 'A' expr ] { ',' 'v' [ 'A' expr ] } ';' | { mod } 'const' [ type ] 'i' 'A' expr ';' | 'use' 'i' { '\\\\' 'i' } { ',' 'i' } ( ';' | '{' { 'i' [ '::' 'i' ] ( 'insteadof' | 'as' ) [ mod ] 'i' ';' } '}' ) | 'case' 'i' [ 'A' expr ] ';' | attr
program = [ 'text' ] 'open' { stmt } 'EOF'
"""

_KT = _c("'in' | 'is' | 'as' | '!' 'in' | '!' 'is' | '?:' | '..' | 'i' | 'to' | 'until' | 'downTo' | 'step'", "'ann'", "'?.' name | '!!' | '::' ( 'i' | 'class' ) | lambda | '<' targs '>' '(' [ args ] ')' | 'as' [ '?' ] type", "[ 'i' 'A' ] expr | '*' expr", "'this' | 'super' | 'null' | 'true' | 'false' | lambda | ifx | 'when' [ '(' [ 'val' 'i' 'A' ] expr ')' ] '{' { warm } '}' | 'try' block nl { 'catch' '(' 'i' ':' type ')' block } [ 'finally' block ] | 'object' [ ':' supers ] cbody | 'return' [ expr ] | 'throw' expr | 'break' | 'continue' | 'fun' params [ ':' type ] fbody | '::' 'i'") + """
name = 'i' | 'class'
nl = { 'NL' }
ifx = 'if' '(' expr ')' nl ( block | expr | stmt ) nl [ 'else' nl ( block | expr | ifx ) ]
warm = 'NL' | ';' | ( 'else' | wc { ',' nl wc } ) '->' ( block | stmt )
wc = expr | [ '!' ] 'in' expr | [ '!' ] 'is' type
lambda = '{' [ lp { ',' lp } '->' ] stmts '}'
lp = 'i' [ ':' type ] | '(' 'i' { ',' 'i' } ')'
type = [ 'suspend' ] ( tone [ '?' ] | [ tone '.' ] params '->' type ) | '(' [ type { ',' type } ] ')' '->' type
tone = 'i' { '.' 'i' } [ '<' targs '>' ]
targs = targ { ',' targ }
targ = [ 'in' | 'out' ] type | '*'
end = ';' | 'NL' | 'EOF'
mod = 'public' | 'private' | 'protected' | 'internal' | 'open' | 'override' | 'abstract' | 'final' | 'data' | 'sealed' | 'inline' | 'suspend' | 'const' | 'lateinit' | 'companion' | 'enum' | 'operator' | 'infix' | 'inner' | 'annotation' | 'vararg' | 'tailrec' | 'external' | 'actual' | 'expect' | ann
ann = '@' 'i' [ ':' 'i' ] { '.' 'i' } [ '(' [ args ] ')' ] nl
param = { mod } [ 'val' | 'var' ] 'i' ':' type [ 'A' expr ]
params = '(' nl [ param { ',' nl param } [ ',' ] nl ] ')'
generics = '<' [ 'reified' | 'in' | 'out' ] 'i' [ ':' type ] { ',' 'i' [ ':' type ] } '>'
block = '{' stmts '}'
fbody = block | 'A' nl expr
var = ( 'val' | 'var' ) [ generics ] ( [ tone '.' ] 'i' | '(' 'i' { ',' 'i' } ')' ) [ ':' type ] [ 'A' nl expr | 'by' expr ]
stmts = { [ stmt ] end } [ stmt ]
stmt = expr [ 'A' expr ] | { mod } var | 'for' '(' ( 'i' [ ':' type ] | '(' 'i' { ',' 'i' } ')' ) 'in' expr ')' nl ( block | stmt ) | 'while' '(' expr ')' ( block | stmt ) | 'do' block 'while' '(' expr ')' | item
items = { [ item ] end } [ item ]
item = 'import' 'i' { '.' ( 'i' | '*' ) } [ 'as' 'i' ] | { mod } 'fun' [ generics ] [ tone '.' ] 'i' params [ ':' type ] [ 'where' 'i' ':' type { ',' 'i' ':' type } ] [ nl fbody ] | { mod } ( 'class' | 'interface' ) 'i' [ generics ] [ { mod } [ 'constructor' ] params ] [ ':' supers ] [ cbody ] | { mod } 'object' [ 'i' ] [ ':' supers ] [ cbody ] | { mod } var [ nl 'get' '(' ')' fbody ] [ nl 'set' '(' 'i' ')' fbody ] | 'typealias' 'i' [ generics ] 'A' type | 'init' block | { mod } 'constructor' params [ ':' ( 'this' | 'super' ) '(' [ args ] ')' ] [ block ] | 'i' [ '(' [ args ] ')' ] [ cbody ] ','
supers = sup { ',' nl sup }
sup = type [ '(' [ args ] ')' ] [ 'by' expr ]
cbody = '{' items '}'
program = { ann } { 'NL' } [ 'package' 'i' { '.' 'i' } end ] stmts 'EOF'
"""

_SWIFT = _c("'is' | 'as' | '??' | '..<' | '...' | '?' expr ':'", "'try' [ '?' | '!' ] | 'await' | '...'", "'?' | '!' | '?.' name | lambda | 'as' [ '?' | '!' ] type | 'is' type | '.' 'n' | 'i' ':' lambda | '.' 'self' | '.' 'init' | '<' type { ',' type } '>'", "[ 'i' ':' ] expr | '&' expr", "'self' | 'Self' | 'super' | 'nil' | 'true' | 'false' | '.' 'i' | '[' [ expr [ ':' expr ] { ',' expr [ ':' expr ] } [ ',' ] ] ']' | '[' ':' ']' | lambda | '(' [ args ] ')' | '#' 'i' | 'ifx' | '_' | '\\\\' [ 'i' ] '.' 'i' | ( 'let' | 'var' ) pattern | 'B' | 'S'") + """
nl = { 'NL' }
lambda = '{' [ lsig 'in' ] stmts '}'
lsig = [ caps ] [ lparam { ',' lparam } | params [ 'async' ] [ 'throws' ] [ '->' type ] ]
caps = '[' cap { ',' cap } ']'
cap = [ 'weak' | 'unowned' ] ( 'i' | 'self' ) [ 'A' expr ]
lparam = 'i' | '_'
type = [ 'inout' | 'some' | 'any' | '@' 'i' ] tone { '?' | '!' } | '(' [ type { ',' type } ] ')' [ 'throws' | 'async' ] '->' type
tone = 'i' { '.' 'i' } [ '<' type { ',' type } '>' ] | '[' type [ ':' type ] ']' | '(' [ [ 'i' ':' ] type { ',' [ 'i' ':' ] type } ] ')' | 'Self' | tone '&' tone
end = ';' | 'NL' | 'EOF'
mod = 'public' | 'private' | 'fileprivate' | 'internal' | 'open' | 'override' | 'static' | 'class' | 'final' | 'mutating' | 'lazy' | 'weak' | 'unowned' | 'convenience' | 'required' | 'indirect' | 'nonmutating' | '@' 'i' [ '(' [ args ] ')' ] nl | 'private' '(' 'set' ')'
param = [ '_' | 'i' ] ( 'i' | '_' ) ':' type [ '...' ] [ 'A' expr ]
params = '(' nl [ param { ',' nl param } nl ] ')'
generics = '<' 'i' [ ':' type { '&' type } ] { ',' 'i' [ ':' type ] } '>'
block = '{' stmts '}'
pattern = 'i' | '_' | '(' pattern { ',' pattern } ')'
var = ( 'let' | 'var' ) pattern [ ':' type ] [ 'A' nl expr ] { ',' pattern [ ':' type ] [ 'A' expr ] } [ '{' { acc } '}' ]
acc = stmts | end | ( 'get' | 'set' | 'willSet' | 'didSet' ) [ '(' 'i' ')' ] [ block ]
cond = expr | ( 'let' | 'var' ) pattern [ ':' type ] [ 'A' expr ] | 'case' [ 'let' ] expr 'A' expr | '#' 'i' '(' [ args ] [ ',' '*' ] ')' | ( 'let' | 'var' ) 'i'
conds = cond { ',' nl cond }
stmts = { [ stmt ] end } [ stmt ]
stmt = expr [ 'A' expr ] | { mod } var | 'if' conds block nl [ 'else' ( block | stmt ) ] | 'guard' conds nl 'else' block | 'for' [ 'case' ] pattern 'in' expr [ 'where' expr ] block | 'while' conds block | 'repeat' block 'while' expr | 'switch' expr '{' { 'NL' | ( 'case' sp { ',' nl sp } [ 'where' expr ] | 'default' | '@' 'i' 'default' ) ':' stmts } '}' | 'return' [ expr ] | 'break' [ 'i' ] | 'continue' [ 'i' ] | 'throw' expr | 'do' block nl { 'catch' [ expr | 'let' 'i' ] block } | 'defer' block | 'fallthrough' | item
sp = [ 'let' | 'var' ] expr | 'is' type
items = { [ member ] end } [ member ]
item = 'import' 'i' { '.' 'i' } | { mod } 'func' ( 'i' | 'B' | 'S' ) [ generics ] params [ 'async' ] [ 'throws' | 'rethrows' ] [ '->' type ] [ 'where' type ( ':' | 'B' ) type { ',' type ( ':' | 'B' ) type } ] [ block ] | { mod } ( 'class' | 'struct' | 'enum' | 'protocol' | 'extension' | 'actor' ) 'i' { '.' 'i' } [ generics ] [ ':' type { ',' type } ] [ 'where' type ( ':' | 'B' ) type { ',' type ( ':' | 'B' ) type } ] '{' items '}' | 'typealias' 'i' [ generics ] 'A' type | 'i' ':' stmt
member = item | { mod } var | { mod } 'init' [ '?' ] [ generics ] params [ 'throws' ] block | 'deinit' block | 'case' 'i' [ '(' [ [ 'i' ':' ] type { ',' [ 'i' ':' ] type } ] ')' ] [ 'A' expr ] { ',' 'i' } | { mod } 'subscript' params '->' type '{' { acc } '}' | 'associatedtype' 'i' [ ':' type ]
program = stmts 'EOF'
"""

_RB = _c("'and' | 'or' | '..' | '/' | '<<' | '=>'", "'not' | 'defined?' | '::' | '..'", "'&.' name | '::' 'i' | blk | '?'", "[ 'lab' ] expr | '*' expr | '**' expr | '&' expr | expr '=>' expr | '&' 'sym' | 'lab'", "'c' | 'v' | 'sym' | 'self' | 'nil' | 'true' | 'false' | 'super' | '[' [ args ] ']' | '{' [ pair { ',' pair } [ ',' ] ] '}' | '->' [ params ] blk | 'yield' | 'if' expr then body 'end' | 'case' [ expr ] nl { 'when' args then body | 'in' pat [ ( 'if' | 'unless' ) expr ] then body } [ 'else' body ] 'end' | 'begin' body { rescue } 'end' | '__method__' | '(' stmts ')' | 's' { 's' }") + """
nl = { 'NL' }
pair = 'lab' [ expr ] | expr '=>' expr | '**' expr | 's' ':' expr
pat = expr | 'c' [ '(' pat { ',' pat } ')' ] | '[' [ pat { ',' pat } ] ']' | '{' [ pp { ',' pp } ] '}' | '*' 'i' | pat 'B' pat | pat '=>' 'i' | pp { ',' pp }
pp = 'lab' [ pat ] | '**' ( 'i' | 'nil' )
name = 'i' | 'c' | 'class' | 'end' | 'then' | 'in' | 'self' | 'begin' | 'if' | 'do' | '(' args ')' | 'next' | 'nil'
blk = ( '{' | 'do' ) [ 'B' bp { ',' bp } 'B' ] stmts ( '}' | 'end' )
bp = [ '*' | '&' | '**' ] 'i' [ 'A' expr ] | 'lab' [ expr ] | '(' 'i' { ',' 'i' } ')'
params = '(' [ bp { ',' bp } ] ')'
then = 'NL' | ';' | 'then'
end = 'NL' | ';' | 'EOF'
body = stmts
rescue = 'rescue' [ 'c' { '::' 'c' } { ',' 'c' } ] [ '=>' 'i' ] then body | 'else' body | 'ensure' body
cmd = [ expr '.' ] ( 'i' | 'yield' | 'super' ) args
simple = expr { ',' expr } [ 'A' ( expr { ',' expr } | cmd | '*' expr ) ] | cmd [ blk ] | 'return' [ args ] | 'break' [ args ] | 'next' [ args ] | 'redo' | 'retry' | 'alias' name name | 'undef' name | '*' 'i' 'A' expr
stmts = { [ stmt ] end } [ stmt ]
stmt = simple { ( 'if' | 'unless' | 'while' | 'until' | 'rescue' ) expr } | ( 'if' | 'unless' ) expr then body { 'elsif' expr then body } [ 'else' body ] 'end' | ( 'while' | 'until' ) expr ( 'do' | 'NL' ) body 'end' | 'for' 'i' { ',' 'i' } 'in' expr ( 'do' | 'NL' ) body 'end' | 'def' [ 'self' '.' | 'i' '.' ] ( name | 'op' | 'B' | 'S' | '<' | '[' ']' ) [ '?' | 'A' ] [ params | bp { ',' bp } ] ( end body { rescue } 'end' | 'A' expr ) | 'class' ( 'c' | '<<' 'self' ) { '::' 'c' } [ '<' expr ] end body 'end' | 'module' 'c' { '::' 'c' } end body 'end' | 'begin' body { rescue } 'end' | 'BEGIN' blk | ( 'private' | 'public' | 'protected' | 'module_function' ) [ args | stmt ]
program = stmts [ '__END__' ] 'EOF'
"""

_PY = _c("'in' | 'not' 'in' | 'is' [ 'not' ] | 'and' | 'or' | 'if' expr 'else' | '**' | '@' | '/' ", "'not' | 'await' | '~' | '**'", "'[' slices ']' | '(' comp ')'", "'*' expr | '**' expr | 'i' 'A' expr | expr ':=' expr", "'None' | 'True' | 'False' | '...' | '[' [ star { ',' star } [ ',' ] | comp ] ']' | '{' [ pair { ',' pair } [ ',' ] | pair fors | star { ',' star } [ ',' ] | comp ] '}' | '(' [ star { ',' star } [ ',' ] | comp ] ')' | 's' { 's' } | 'lambda' [ lparams ] ':' expr | 'yield' [ 'from' ] [ expr ] | soft") + """
soft = 'match' | 'case' | 'type' | '_'
star = [ '*' ] expr [ ':=' expr ]
pair = expr ':' expr | '**' expr
fors = [ 'async' ] 'for' targets 'in' expr { 'if' expr | 'for' targets 'in' expr }
comp = expr fors
targets = [ '*' ] expr { ',' [ '*' ] expr } [ ',' ]
slice = [ expr ] ':' [ expr ] [ ':' [ expr ] ] | expr | '*' expr
slices = slice { ',' slice } [ ',' ]
name = 'i' | soft
lparams = lp { ',' lp } [ ',' ]
lp = 'i' [ 'A' expr ] | '*' [ 'i' ] | '**' 'i' | '/'
params = '(' [ p { ',' p } [ ',' ] ] ')'
p = 'i' [ ':' expr ] [ 'A' expr ] | '*' [ 'i' [ ':' expr ] ] | '**' 'i' [ ':' expr ] | '/'
tuple = star { ',' star } [ ',' ]
end = 'NL' | ';' [ 'NL' ]
suite = ':' 'CNL' '>>' { stmt } '<<' | ':' simple
simple = small end
small = tuple { ( 'A' | '@' 'A' | 'B' 'A' ) tuple } | expr ':' expr [ 'A' tuple ] | 'pass' | 'break' | 'continue' | 'return' [ tuple ] | 'raise' [ expr [ 'from' expr ] ] | 'import' dotted [ 'as' 'i' ] { ',' dotted [ 'as' 'i' ] } | 'from' ( { '.' | '...' } dotted | '.' { '.' } | '...' ) 'import' ( '*' | '(' 'i' [ 'as' 'i' ] { ',' 'i' [ 'as' 'i' ] } [ ',' ] ')' | name [ 'as' 'i' ] { ',' name [ 'as' 'i' ] } ) | ( 'global' | 'nonlocal' ) 'i' { ',' 'i' } | 'del' targets | 'assert' expr [ ',' expr ] | 'type' 'i' [ '[' 'i' { ',' 'i' } ']' ] 'A' expr
dotted = name { '.' name }
stmt = simple | 'if' expr [ ':=' expr ] suite | 'elif' expr suite | 'else' suite | 'while' expr suite | [ 'async' ] 'for' targets 'in' tuple suite | 'try' suite | 'except' [ '*' ] [ tuple [ 'as' 'i' ] ] suite | 'finally' suite | [ 'async' ] 'with' expr [ 'as' expr ] { ',' expr [ 'as' expr ] } suite | '@' expr 'NL' | [ 'async' ] 'def' name [ '[' 'i' ']' ] params [ '->' expr ] suite | 'class' name [ '(' [ args ] ')' ] suite | 'match' expr suite | 'case' tuple [ 'if' expr ] suite
program = { stmt } 'EOF'
"""

_JSON = """
value = 's' | 'n' | 'true' | 'false' | 'null' | '[' [ value { ',' value } ] ']' | '{' [ 's' ':' value { ',' 's' ':' value } ] '}'
program = value 'EOF'
"""

GRAMMARS = {"python": _PY, "javascript": _JS, "typescript": _TS, "go": _GO, "rust": _RS, "java": _JAVA, "csharp": _CS, "ruby": _RB, "c": _CC, "cpp": _CC, "kotlin": _KT, "swift": _SWIFT, "php": _PHP, "json": _JSON}


def _parse(text: str) -> dict:
    rules = {}
    for line in text.strip().splitlines():
        name, _, body = line.partition(" = ")
        tokens = re.findall(r"'(?:[^'])*'|[A-Za-z_]+|[|{}\[\]()]", body)
        pos = 0

        def alt():
            nonlocal pos
            options = [seq()]
            while pos < len(tokens) and tokens[pos] == "|":
                pos += 1
                options.append(seq())
            return ("alt", options)

        def seq():
            nonlocal pos
            parts = []
            while pos < len(tokens) and tokens[pos] not in ("|", "}", "]", ")"):
                t = tokens[pos]
                pos += 1
                if t in "{[(":
                    inner = alt()
                    pos += 1
                    parts.append({"{": ("many", inner), "[": ("opt", inner), "(": inner}[t])
                elif t[0] == "'":
                    parts.append(("t", t[1:-1].replace("\\\\", "\\")))
                else:
                    parts.append(("n", t))
            return ("seq", parts)

        rules[name.strip()] = alt()
    return rules


@cache
def pairs(language: str) -> frozenset[tuple[str, str]]:
    """All (left, right) token classes that may stand side by side."""
    rules = _parse(GRAMMARS[language])
    info = {k: (False, frozenset(), frozenset()) for k in rules}
    found: set[tuple[str, str]] = set()

    def look(node):
        kind = node[0]
        if kind == "t":
            return (False, frozenset([node[1]]), frozenset([node[1]])) if node[1] != "\\0" else (False, frozenset(), frozenset())
        if kind == "n":
            return info[node[1]]
        if kind in ("opt", "many"):
            _, f, la = look(node[1])
            if kind == "many":
                found.update((a, b) for a in la for b in f)
            return True, f, la
        if kind == "alt":
            all_ = [look(x) for x in node[1]]
            return any(x[0] for x in all_), frozenset().union(*(x[1] for x in all_)), frozenset().union(*(x[2] for x in all_))
        null, first, last = True, frozenset(), frozenset()
        for part in node[1]:
            n, f, la = look(part)
            found.update((a, b) for a in last for b in f)
            first = first | f if null else first
            last = last | la if n else la
            null = null and n
        return null, first, last

    while True:
        before = (dict(info), len(found))
        for k, node in rules.items():
            info[k] = look(node)
        if (dict(info), len(found)) == before:
            break
    found |= {("BOF", b) for b in info["program"][1]}
    return frozenset(found)
