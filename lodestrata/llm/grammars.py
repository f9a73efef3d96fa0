"""Grammars of the supported languages over token classes: n name, 0 number, s string, c character, t template."""

from __future__ import annotations

import re

JAVA = """
Top = TopItem*
TopItem = ';' | Mod* 'package' Q ';' | 'import' 'static'? Q ('.' '*')? ';' | Type_ | Member
Type_ = Mod* ('class' | 'interface' | '@' 'interface' | 'record' Id Generic? (:Params) | 'enum') TypeRest | Mod* 'record' Id Generic? (:Params) ('implements' Types)? {:Body}
TypeRest = Id Generic? Clause* {:Body} | Clause* {:Body}
Clause = ('extends' | 'implements' | 'permits') Types
Generic = '<' TypeParam (',' TypeParam)* '>'
TypeParam = Ann* Id ('extends' Type ('&' Type)*)?
Types = Type (',' Type)*
Mod = 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' | Ann
Ann = '@' Q (:AnnArgs)?
AnnArgs = | AnnArg (',' AnnArg)* ','?
AnnArg = Id '=' AnnValue | AnnValue
AnnValue = E | Ann | {:AnnArgs}
Id = n | 'record' | 'var' | 'sealed' | 'permits' | 'yield' | 'non' | 'module' | 'when'
Q = Id ('.' Id)*
Prim = 'int' | 'long' | 'double' | 'float' | 'boolean' | 'char' | 'byte' | 'short' | 'void'
Dims = [:Empty]*
Empty =
Type = Ann* (Prim Dims | Named ('.' Ann* Named)* Dims)
Named = Id Args_?
Args_ = '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg = Ann* ('?' (('extends' | 'super') Type)? | Type)
Body = Member* | Consts (';' Member*)?
Consts = Const (',' Const)* ','?
Const = Ann* Id (:Args)? {:Body}?
Member = ';' | 'static'? {:Stmts} | Type_ | Mod* Generic? Type Id (:Params) Dims Throws? ({:Stmts} | ';' | 'default' AnnValue ';') | Mod* Generic? Id (:Params) Throws? {:Stmts} | Mod* Id {:Stmts} | Mod* Type Vars ';'
Throws = 'throws' Types
Params = | Param (',' Param)*
Param = ('final' | Ann)* Type '...'? (Id Dims | Id '.' 'this' | 'this')
Vars = Var (',' Var)*
Var = Id Dims ('=' Init)?
Init = E | {:Inits}
Inits = | Init (',' Init)* ','?
Stmts = Stmt*
Stmt = ';' | {:Stmts} | 'if' (:E) Stmt ('else' Stmt)? | 'while' (:E) Stmt | 'do' Stmt 'while' (:E) ';' | 'for' (:For) Stmt | 'try' (:Resources)? {:Stmts} Catch* ('finally' {:Stmts})? | Switch | 'return' E? ';' | 'throw' E ';' | 'break' Id? ';' | 'continue' Id? ';' | 'yield' E ';' | 'synchronized' (:E) {:Stmts} | 'assert' E (':' E)? ';' | Id ':' Stmt | Local ';' | Effect ';' | Type_
Effect = Post AssignOp (E | Lambda) | ('++' | '--') Un | Prime Suffix* ('++' | '--' | (:Args)) | New | Switch
Local = ('final' | Ann)* Type Vars
Catch = 'catch' (:CatchParam) {:Stmts}
CatchParam = ('final' | Ann)* Type ('|' Type)* Id
Resources = Resource (';' Resource)* ';'?
Resource = ('final' | Ann)* Type Id '=' E | E
For = ForInit? ';' E? ';' Es? | ('final' | Ann)* Type Id ':' E
ForInit = Local | Es
Es = E (',' E)*
Switch = 'switch' (:E) {:Cases}
Cases = Case*
Case = ('case' Labels ('when' E)? | 'default') (':' Stmts | '->' (E ';' | {:Stmts} | 'throw' E ';'))
Labels = Label (',' Label)*
Label = E | Pattern | 'default'
Pattern = ('final' | Ann)* Type (Id | (:Patterns) Id?)
Patterns = | Pattern (',' Pattern)*
E = Cond (AssignOp E)? | Lambda
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
Cond = Bin ('?' E ':' (Cond | Lambda))?
Bin = Un (Op Un | 'instanceof' (Type | Pattern))*
Op = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>'
Un = ('+' | '-' | '!' | '~' | '++' | '--') Un | (:Cast) Un | (:Cast) Lambda | Post
Cast = Type ('&' Type)*
Post = Prime Suffix* ('++' | '--')?
Suffix = '.' Args_? Id | '.' 'class' | '.' 'this' | '.' 'super' | '.' New | (:Args) | [:E] | '::' Args_? (Id | 'new')
Prime = Id | 0 | s | c | 'true' | 'false' | 'null' | 'this' | 'super' | (:E) | New | Switch | Type '.' 'class' | Type '::' (Id | 'new')
New = 'new' Ann* (Prim | Named ('.' Named)*) ((:Args) {:Body}? | ([:E] | [:Empty])+ {:Inits}?)
Args = | Arg (',' Arg)*
Arg = E
Lambda = (Id | (:LambdaParams)) '->' (E | {:Stmts})
LambdaParams = | Id (',' Id)* | Params
"""

CSHARP = """
Top = TopItem*
TopItem = ';' | 'extern' 'alias' Id ';' | 'global'? 'using' 'static'? (Id '=')? Type ';' | 'namespace' Q ({:Top} ';'? | ';') | Attr* 'namespace' Q {:Top} | Type_ | Attr | Stmt
Attr = [:Attrs]
Attrs = (Id ':')? AttrOne (',' AttrOne)* ','?
AttrOne = Q (:Args)?
Q = Named (('.' | '::') Named)*
Named = Id Args_?
Args_ = '<' (Type (',' Type)*)? '>' | '<' ','+ '>'
Id = n | 'var' | 'async' | 'await' | 'get' | 'set' | 'init' | 'add' | 'remove' | 'value' | 'where' | 'when' | 'from' | 'select' | 'group' | 'into' | 'orderby' | 'join' | 'let' | 'on' | 'equals' | 'by' | 'ascending' | 'descending' | 'partial' | 'record' | 'yield' | 'dynamic' | 'nameof' | 'global' | 'alias' | 'and' | 'or' | 'not' | 'with' | 'required' | 'file' | 'scoped' | 'managed' | 'notnull' | 'unmanaged'
Mod = 'public' | 'private' | 'protected' | 'internal' | 'static' | 'readonly' | 'sealed' | 'abstract' | 'virtual' | 'override' | 'async' | 'extern' | 'unsafe' | 'volatile' | 'partial' | 'new' | 'const' | 'ref' | 'required' | 'file' | 'fixed'
Type_ = Attr* Mod* ('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) Id Generic? (:Params)? (':' Bases)? Where* ({:Members} ';'? | ';') | Attr* Mod* 'enum' Id (':' Type)? {:Enum} ';'? | Attr* Mod* 'delegate' Type Id Generic? (:Params) Where* ';'
Bases = Type (:Args)? (',' Type (:Args)?)*
Generic = '<' Attr* ('in' | 'out')? Id (',' Attr* ('in' | 'out')? Id)* '>'
Where = 'where' Id ':' Bound (',' Bound)*
Bound = Type | 'class' '?'? | 'struct' | 'new' (:Empty) | 'default'
Empty =
Enum = | EnumOne (',' EnumOne)* ','?
EnumOne = Attr* Id ('=' E)?
Prim = 'int' | 'long' | 'double' | 'float' | 'bool' | 'char' | 'byte' | 'short' | 'void' | 'string' | 'object' | 'decimal' | 'uint' | 'ulong' | 'ushort' | 'sbyte' | 'nint' | 'nuint'
Type = ('ref' 'readonly'? | 'scoped')? (Prim | Q | (:TupleType)) ('?' | '*' | [:Ranks])*
TupleType = Type Id? (',' Type Id?)+
Ranks = ','*
Members = Member*
Member = ';' | Type_ | Attr* Mod* Type Names Where* Callable | Attr* Mod* Type Vars ';' | Attr* Mod* 'event' Type (Vars ';' | Names {:Accessors}) | Attr* Mod* Type Names ({:Accessors} ('=' Init ';')? | '=>' E ';') | Attr* Mod* Type (Q '.')? 'this' [:Params] ({:Accessors} | '=>' E ';') | Attr* Mod* Id (:Params) (':' ('base' | 'this') (:Args))? Code | Attr* Mod* '~' Id (:Params) Code | Attr* Mod* Type 'operator' OverOp (:Params) Code | Attr* Mod* ('implicit' | 'explicit') 'operator' Type (:Params) Code
OverOp = Op | '!' | '~' | '++' | '--' | 'true' | 'false'
Names = Q
Callable = Generic? (:Params) Where* Code
Code = {:Stmts} | '=>' E ';' | ';'
Accessors = Accessor*
Accessor = Attr* Mod* ('get' | 'set' | 'init' | 'add' | 'remove') ({:Stmts} | '=>' E ';' | ';')
Params = | Param (',' Param)*
Param = Attr* ('this' | 'ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* Type Id ('=' E)? | '__arglist'
Vars = Var (',' Var)*
Var = Id [:Es]? ('=' Init)?
Init = E | {:Inits} | 'stackalloc' Type [:Es]
Inits = | InitOne (',' InitOne)* ','?
InitOne = Init | [:Es] '=' Init | Id '=' Init
Stmts = Stmt*
Stmt = ';' | {:Stmts} | 'if' (:E) Stmt ('else' Stmt)? | 'while' (:E) Stmt | 'do' Stmt 'while' (:E) ';' | 'for' (:For) Stmt | 'await'? 'foreach' (:Each) Stmt | 'try' {:Stmts} Catch* ('finally' {:Stmts})? | 'switch' (:E) {:Cases} | 'return' ('ref'? E)? ';' | 'throw' E? ';' | 'break' ';' | 'continue' ';' | 'goto' ('case' E | 'default' | Id) ';' | 'yield' ('return' E | 'break') ';' | 'lock' (:E) Stmt | 'await'? 'using' (:Using) Stmt | 'await'? 'using' Local ';' | ('checked' | 'unchecked' | 'unsafe') {:Stmts} | 'fixed' (:Using) Stmt | Id ':' Stmt | 'const'? Local ';' | Attr* Mod* Type Id Generic? (:Params) Where* Code | E ';'
Local = Type Vars
Using = Local | E
Catch = 'catch' (:CatchParam)? ('when' (:E))? {:Stmts}
CatchParam = Type Id?
For = (Local | Es)? ';' E? ';' Es?
Each = ('var' | Type)? (Type Id | (:Es)) 'in' E
Es = | E (',' E)*
Cases = Section*
Section = Label+ Stmt+
Label = 'case' Pattern ('when' E)? ':' | 'default' ':'
Pattern = PatOne (('and' | 'or') PatOne)*
PatOne = 'not'? (E | Type Id? | Type? {:PropPats} Id? | Type? (:PosPats) {:PropPats}? Id? | ('<' | '>' | '<=' | '>=') Un | 'var' (Id | (:Es)) | [:PosPats] Id? | '..' PatOne?)
PropPats = | PropPat (',' PropPat)* ','?
PropPat = Q ':' Pattern
PosPats = | PosPat (',' PosPat)* ','?
PosPat = (Id ':')? Pattern
E = Cond (AssignOp (E | 'ref' E))? | Lambda | Query | 'throw' E
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '??='
Cond = Bin ('?' ('ref'? E) ':' ('ref'? E))?
Bin = Un (Op Un | 'is' Pattern | 'as' Type | 'switch' {:Arms} | 'with' {:Inits} | '..' Un?)* | '..' Un?
Arms = | Arm (',' Arm)* ','?
Arm = Pattern ('when' E)? '=>' E
Op = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '??' ('throw')?
Un = ('+' | '-' | '!' | '~' | '++' | '--' | '^' | '&' | '*' | 'await') Un | (:Cast) Un | Post
Cast = Type
Post = Prime Suffix* ('++' | '--')?
Suffix = '.' Named | '?.' Named | '->' Named | (:Args) | '?'? [:Args] | '!'
Prime = Named | 0 | s | c | 'true' | 'false' | 'null' | 'this' | 'base' | Prim | (:Paren) | New | 'typeof' (:Type) | 'default' (:Type)? | 'sizeof' (:Type) | ('checked' | 'unchecked') (:E) | 'delegate' (:Params)? {:Stmts} | [:CollectionItems] | 'stackalloc' Type? [:Es] {:Inits}? | '::' Named | Id '::' Named
CollectionItems = | ('..'? E) (',' '..'? E)* ','?
Paren = E | TupleItem (',' TupleItem)+
TupleItem = (Id ':')? (E | Type Id)
New = 'new' (NewType ((:Args) {:Inits}? | {:Inits}) | NewType [:Es]+ ([:Ranks])* {:Inits}? | (:Args) {:Inits}? | {:Inits} | [:Ranks] {:Inits})
NewType = Prim '?'? | Q '?'?
Args = | Arg (',' Arg)*
Arg = (Id ':')? ('ref' | 'out' | 'in')? (E | Type Id)
Lambda = Attr* ('async' | 'static')* (Id | Type? (:LambdaParams)) '=>' (E | {:Stmts})
LambdaParams = | Id (',' Id)* | Params
Query = 'from' Type? Id 'in' E QueryPart+
QueryPart = 'from' Type? Id 'in' E | 'where' E | 'let' Id '=' E | 'join' Type? Id 'in' E 'on' E 'equals' E ('into' Id)? | 'orderby' E ('ascending' | 'descending')? (',' E ('ascending' | 'descending')?)* | 'select' E | 'group' E 'by' E | 'into' Id
"""

GO = """
Top = TopItem*
TopItem = ';' | 'package' Id ';' | 'import' (Import | (:Imports)) ';' | Decl ';' | Func ';'
Imports = (Import? ';')* Import?
Import = (Id | '.')? s
Id = n
Decl = 'const' (Const | (:Consts)) | 'var' (Var | (:Vars)) | 'type' (TypeDef | (:TypeDefs))
Consts = (Const? ';')* Const?
Const = Ids (Type? '=' Es)?
Vars = (Var? ';')* Var?
Var = Ids (Type ('=' Es)? | '=' Es)
TypeDefs = (TypeDef? ';')* TypeDef?
TypeDef = Id [:TypeParams]? '='? Type
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = Ids Bound
Bound = '~'? Type ('|' '~'? Type)*
Ids = Id (',' Id)*
Func = 'func' (:Params)? Id [:TypeParams]? Sig {:Stmts}? | 'func' Id [:TypeParams]? Sig {:Stmts}?
Sig = (:Params) (Type | (:Params))?
Params = | Param (',' Param)* ','?
Param = Ids? '...'? Type
Type = Name [:TypeArgs]? | '*' Type | [:E] Type | [:Empty] Type | [:Dots] Type | 'map' [:Type] Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Sig | 'struct' {:Fields} | 'interface' {:Methods} | (:Type)
Dots = '...'
TypeArgs = Type (',' Type)* ','?
Empty =
Name = Id ('.' Id)?
Fields = (Field? ';')* Field?
Field = (Ids Type | '*'? Name [:TypeArgs]?) s?
Methods = (Method? ';')* Method?
Method = Id Sig | Bound
Stmts = (Stmt? ';')* Stmt?
Stmt = Decl | 'return' Es? | 'if' Head {:Stmts} ('else' (Stmt))? | 'for' ForHead? {:Stmts} | 'switch' SwitchHead? {:Cases} | 'select' {:Cases} | 'go' E | 'defer' E | 'break' Id? | 'continue' Id? | 'goto' Id | 'fallthrough' | {:Stmts} | Id ':' Stmt? | Simple
Simple = Es | Es AssignOp Es | E ('++' | '--') | E '<-' E
AssignOp = '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
Head = (Simple? ';')? E
ForHead = Simple? ';' E? ';' Simple? | E | (Es ('=' | ':='))? 'range' E
SwitchHead = (Simple? ';')? Simple?
Cases = Case*
Case = ('case' CaseList | 'default') ':' Stmts
CaseList = Simple | TypeArgs | Es
Es = E (',' E)*
E = Un (Op Un)*
Op = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '<-'
Un = ('+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~') Un | Post
Post = Prime Suffix*
Suffix = '.' Id | '.' (:Assert) | (:Args) | [:Index] | {:Literal}
Assert = Type | 'type'
Index = E | TypeArgs | E? ':' E? | E? ':' E ':' E | E ','?
Args = | (E | Type) (',' (E | Type))* '...'? ','?
Prime = Id | 0 | s | c | (:E) | (:Type) | 'func' Sig {:Stmts} | LitType {:Literal} | Type (:Args)
LitType = 'map' [:Type] Type | [:E] Type | [:Empty] Type | [:Dots] Type | 'struct' {:Fields}
Literal = | Item (',' Item)* ','? ';'?
Item = (Value ':')? Value
Value = E | {:Literal}
"""

SCRIPT = """
Top = TopItem*
TopItem = Import | Export | Stmt
Import = 'import' 'type'? (s | (Bind | 'type'? Star | {:Names} | Bind ',' (Star | {:Names})) 'from' s) With? ';' | 'import' Id '=' E ';'
With = ('with' | 'assert') {:Object}
Star = '*' 'as' Id
Names = | Spec (',' Spec)* ','?
Spec = 'type'? (Word | s) ('as' (Word | s))?
Export = 'export' (Decorator* Decl | 'default' (Func | Class | 'interface' Id Generic? {:Members} | E ';'? ) ';'? | 'type'? {:Names} ('from' s With?)? ';' | '*' ('as' Word)? 'from' s With? ';' | '=' E ';' | 'import' Id '=' E ';') | 'export' 'as' 'namespace' Id ';'
Decl = Func | Class | VarDecl ';' | TsDecl
Bind = Id
Id = n | Ctx
Ctx = 'async' | 'get' | 'set' | 'of' | 'from' | 'as' | 'type' | 'interface' | 'enum' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'static' | 'public' | 'private' | 'protected' | 'override' | 'satisfies' | 'is' | 'infer' | 'keyof' | 'unique' | 'asserts' | 'global' | 'accessor' | 'let' | 'implements' | 'await' | 'yield' | 'target' | 'any' | 'assert' | 'using'
Word = Id | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with'
Module = TopItem* ('export'? VarDecl | 'export'? 'type' Id Generic? '=' Type | Es)?
Stmts = Stmt*
Stmt = ';' | {:Block} | VarDecl ';' | Func | Class | TsDecl | 'if' (:Es) Stmt ('else' Stmt)? | 'while' (:Es) Stmt | 'do' Stmt 'while' (:Es) ';'? | 'for' 'await'? (:For) Stmt | 'try' {:Block} ('catch' (:CatchParam)? {:Block})? ('finally' {:Block})? ';'? | 'switch' (:Es) {:Cases} | 'return' Es? ';' | 'throw' Es ';' | 'break' Id? ';' | 'continue' Id? ';' | 'debugger' ';' | 'with' (:Es) Stmt | Id ':' Stmt | Es ';' | Decorator
Block = Stmts Tail?
Tail = VarDecl | 'return' Es? | 'throw' Es | 'break' Id? | 'continue' Id? | Es | 'if' (:Es) Tail | 'if' (:Es) Stmt 'else' Tail | 'while' (:Es) Tail | 'for' 'await'? (:For) Tail | Id ':' Tail
VarDecl = ('var' | 'let' | 'const' | 'using' | 'const' 'enum') Vars
Vars = Var (',' Var)*
Var = Pattern '!'? (':' Type)? ('=' E)?
Pattern = Id | {:ObjPats} | [:ArrPats]
ObjPats = | ObjPat (',' ObjPat)* ','?
ObjPat = '...' Pattern | Key ':' Pattern ('=' E)? | Id ('=' E)?
ArrPats = ArrPat (',' ArrPat)*
ArrPat = | '...'? Pattern ('=' E)?
CatchParam = Pattern (':' Type)?
For = (VarDecl | Es)? ';' Es? ';' Es? | ('var' | 'let' | 'const')? (Pattern | E) (':' Type)? ('of' E | 'in' Es)
Cases = Case*
Case = ('case' Es | 'default') ':' Block
Func = 'async'? 'function' '*'? Id? Generic? (:Params) Ret? ({:Block} | ';') ';'?
Params = | Param (',' Param)* ','?
Param = Decorator* Access* ('...'? Pattern '?'? (':' Type)? ('=' E)? | 'this' ':' Type)
Access = 'public' | 'private' | 'protected' | 'readonly' | 'override'
Ret = ':' Type | ':' ('asserts')? (Id | 'this') 'is' Type | ':' 'asserts' (Id | 'this')
Class = Decorator* 'abstract'? 'class' Id? Generic? ('extends' Un TypeArgs?)? ('implements' Type (',' Type)*)? {:Members} ';'?
Decorator = '@' (Id ('.' Word)* | (:E)) (:Args)?
Members = Member* (Decorator* MemMod* Key ('?' | '!')?)?
Member = ';' | 'static' {:Block} | Decorator* MemMod* Method | Decorator* MemMod* Key ('?' | '!')? (':' Type ('=' E)? | '=' E) (';' | ',')? | Decorator* MemMod* Key ('?' | '!')? (';' | ',') | MemMod* [:IndexSig] '?'? (':' Type) (';' | ',')? | ('new')? Generic? (:Params) Ret? (';' | ',')?
MemMod = 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'async' | 'accessor' | '+' | '-'
Method = ('async' | '*' | 'get' | 'set')* Key '?'? Generic? (:Params) Ret? ({:Block} | ';' | ',')?
IndexSig = Id ':' Type | Id 'in' Type ('as' Type)?
Key = Word | s | 0 | [:E] | '#' Word
TsDecl = 'declare' (TsDecl | Func | Class | VarDecl ';' | 'global' {:Module}) | 'interface' Id Generic? ('extends' Type (',' Type)*)? {:Members} ';'? | 'type' Id Generic? '=' Type ';' | 'const'? 'enum' Id {:Enum} ';'? | ('namespace' | 'module') (Id ('.' Id)* | s) ({:Module} | ';') ';'?
Enum = | EnumOne (',' EnumOne)* ','?
EnumOne = Key ('=' E)?
Generic = '<' 'const'? GenericOne (',' GenericOne)* ','? '>'
GenericOne = ('in' | 'out' | 'const')* Id ('extends' Type)? ('=' Type)?
TypeArgs = '<' Type (',' Type)* '>'
Type = '|'? '&'? TypeUn (('|' | '&') TypeUn)* ('extends' TypeUn '?' Type ':' Type)? | Generic? (:Params) '=>' Type | 'abstract'? 'new' Generic? (:Params) '=>' Type | Generic? (:Params) '=>' ('asserts')? (Id | 'this') 'is' Type
TypeUn = ('keyof' | 'readonly' | 'unique' | 'infer') TypeUn ('extends' TypeUn)? | TypeOne ([:Empty] | [:Type] | '!')*
Empty =
TypeOne = Id ('.' Word)* TypeArgs? | 'void' | 'null' | 'this' | 'true' | 'false' | '-'? 0 | s | t | 'typeof' Id ('.' Word)* TypeArgs? | 'typeof' 'import' (:Args) | 'import' (:Args) ('.' Word)* TypeArgs? | {:Members} | [:TupleTypes] | (:Type)
TupleTypes = | TupleType (',' TupleType)* ','?
TupleType = '...'? (Id '?'? ':')? '...'? Type '?'?
Es = E (',' E)*
E = Arrow | 'yield' '*'? E? | Cond (AssignOp E)? | {:ObjPats} '=' E | [:ArrPats] '=' E
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&&=' | '||=' | '??='
Arrow = 'async'? (Id | Generic? (:Params) Ret?) '=>' (E | {:Block})
Cond = Bin ('?' E ':' E)?
Bin = Un (Op Un | ('as' | 'satisfies') ('const' | Type))*
Op = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof'
Un = ('+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await') Un | '<' Type '>' Un | Post
Post = Prime Suffix* ('++' | '--')?
Suffix = '.' (Word | '#' Word) | '?.' (Word | '#' Word) | '?.' (:Args) | '?.' [:Es] | TypeArgs? (:Args) | [:Es] | t | '!' | TypeArgs
Prime = Id | 0 | s | t | r | j | 'true' | 'false' | 'null' | 'this' | 'super' | (:Es) | [:Array] | {:Object} | Func | Class | 'new' New | 'new' '.' Id | 'import' (:Args) | 'import' '.' Id | '#' Word
New = 'new'? NewHead ('.' Word | [:Es])* TypeArgs? (:Args)?
NewHead = Id | 'this' | 'super' | (:Es) | Func | Class | 'import' '.' Id
Array = ArrayOne (',' ArrayOne)*
ArrayOne = | '...'? E
Object = | Prop (',' Prop)* ','?
Prop = '...' E | Key ':' E | Id ('=' E)? | ('async' | 'get' | 'set' | '*')* Key Generic? (:Params) Ret? {:Block}
Args = | '...'? E (',' '...'? E)* ','?
"""

#: The same without types.
JAVASCRIPT = re.sub(r"^(Type|TsDecl|Generic|TypeArgs|Ret|Access) = .*$", r"\1 = 'no such token'", SCRIPT, flags=re.M)

#: Expressions and names, the same in both dialects; ⟨⟩ is an indented block, ¶ the end of a logical line.
_PYTHON_EXPRESSIONS = """
Ids = Id (',' Id)*
Id = n | 'match' | 'case' | 'type' | 'print' | 'exec' | '_'
Dotted = Id ('.' Id)*
Names = Id ('as' Id)? (',' Id ('as' Id)?)* ','?
Items = Item (',' Item)* ','?
Item = E ('as' Target)?
TypeParams = TypeParam (',' TypeParam)* ','?
TypeParam = ('*' | '**')? Id (':' E)? ('=' E)?
Params = | Positional (',' Starred)? ','? | Starred ','?
Positional = Plain (',' Plain)* (',' Preset)* | Plain (',' Plain)* ',' '/' (',' Plain)* (',' Preset)* | Plain (',' Plain)* (',' Preset)+ ',' '/' (',' Preset)* | Preset (',' Preset)* (',' '/' (',' Preset)*)?
Starred = '*' Id (':' '*'? E)? (',' (Plain | Preset))* (',' '**' Plain)? | '*' (',' (Plain | Preset))+ (',' '**' Plain)? | '**' Plain
Plain = Id (':' E)?
Preset = Plain '=' E
Targets = TargetStar (',' TargetStar)* ','?
TargetStar = '*'? Target
Target = Id | Place | (:Targets) | [:Targets] | (:Empty) | [:Empty]
Place = Prime Suffix* ('.' Id | [:Subs])
Single = Id | Place | (:SingleOne)
SingleOne = Single
Empty =
Right = Es | Yield
Yield = 'yield' ('from' E | Es)?
Es = EStar (',' EStar)* ','?
EStar = '*' Or | E
NEs = NStar (',' NStar)* ','?
NStar = '*' Or | NE
NE = Id ':=' E | E
E = Or ('if' Or 'else' E)? | Lambda
Lambda = 'lambda' LambdaParams ':' E
LambdaParams = | LPositional (',' LStarred)? ','? | LStarred ','?
LPositional = Id (',' Id)* (',' LPreset)* | Id (',' Id)* ',' '/' (',' Id)* (',' LPreset)* | Id (',' Id)* (',' LPreset)+ ',' '/' (',' LPreset)* | LPreset (',' LPreset)* (',' '/' (',' LPreset)*)?
LStarred = '*' Id (',' (Id | LPreset))* (',' '**' Id)? | '*' (',' (Id | LPreset))+ (',' '**' Id)? | '**' Id
LPreset = Id '=' E
Or = Not (('and' | 'or') Not)*
Not = 'not' Not | Cmp
Cmp = Bin (CmpOp Bin)*
CmpOp = '<' | '>' | '==' | '!=' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '<>'
Bin = Un (BinOp Un)*
BinOp = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**'
Un = ('+' | '-' | '~' | 'await') Un | Post
Post = Prime Suffix*
Suffix = '.' Id | (:Args) | [:Subs]
Prime = Id | 0 | s+ | 'None' | 'True' | 'False' | '...' | (:Paren) | [:List] | {:Dict}
Paren = | NEs | Yield | NStar Comp
List = | NEs | NStar Comp
Comp = ('async'? 'for' Targets 'in' Or ('if' NoElse)*)+
NoElse = Id ':=' E | Or | Lambda
Dict = | DictOne (',' DictOne)* ','? | E ':' E Comp | NEs | NStar Comp
DictOne = E ':' E | '**' Or
Args = | Given (',' Given)* (',' Named (',' Named)*)? (',' Last (',' Last)*)? ','? | Named (',' Named)* (',' Last (',' Last)*)? ','? | Last (',' Last)* ','? | NE Comp
Given = '*' E | NE
Named = Id '=' E | '*' E
Last = Id '=' E | '**' E
Subs = Sub (',' Sub)* ','?
Sub = '*' Or | NE | E? ':' E? (':' E?)?
Patterns = PatStar (',' PatStar)* ','?
PatStar = '*' Id | Pat
Pat = PatOr ('as' Id)?
PatOr = PatOne ('|' PatOne)*
PatOne = '-'? 0 (('+' | '-') 0)? | s+ | 'None' | 'True' | 'False' | Dotted (:PatArgs)? | (:PatSeq) | [:PatSeq] | {:PatMap}
PatSeq = | Patterns
PatArgs = | PatArg (',' PatArg)* ','?
PatArg = (Id '=')? Pat
PatMap = | PatPair (',' PatPair)* ','?
PatPair = PatOne ':' Pat | '**' Id
"""

#: Statements of a dialect; rules that end in V belong to it.
_PYTHON_STATEMENTS = """
FileV = StmtV*
BlockV = StmtV*
StmtV = SimpleV | CompoundV
SimpleV = SmallV (';' SmallV)* ';'? '¶'
SuiteV = '¶' ⟨:BlockV⟩ | SimpleV
CompoundV = 'if' NE ':' SuiteV ('elif' NE ':' SuiteV)* ElseV? | 'while' NE ':' SuiteV ElseV? | 'async'? 'for' Targets 'in' Es ':' SuiteV ElseV? | 'try' ':' SuiteV (ExceptV+ ElseV? FinallyV? | FinallyV) | 'async'? 'with' (Items | (:Items)) ':' SuiteV | Decorator* 'async'? 'def' Id [:TypeParams]? (:Params) ('->' E)? ':' SuiteV | Decorator* 'class' Id [:TypeParams]? (:Args)? ':' SuiteV | 'match' NEs ':' '¶' ⟨:CasesV⟩
ElseV = 'else' ':' SuiteV
FinallyV = 'finally' ':' SuiteV
ExceptV = 'except' ('*'? E (',' E)* ('as' Id)?)? ':' SuiteV
CasesV = CaseV+
CaseV = 'case' Patterns ('if' NE)? ':' SuiteV
Decorator = '@' NE '¶'
SmallV = Es | Yield | (Targets '=')+ Right | Single AugOp Right | Single ':' E ('=' Right)? | 'pass' | 'break' | 'continue' | 'return' Es? | 'raise' (E ('from' E)?)? | 'global' Ids | 'nonlocal' Ids | 'del' Targets | 'assert' E (',' E)? | 'import' Dotted ('as' Id)? (',' Dotted ('as' Id)?)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | Names | (:Names)) | 'type' Id [:TypeParams]? '=' E
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '>>=' | '<<=' | '&=' | '|=' | '^=' | '@='
"""


def _statements(version: str) -> str:
    return re.sub(r"\b([A-Z][A-Za-z]*)V\b", rf"\g<1>{version}", _PYTHON_STATEMENTS)


#: Statements that only the older dialect has.
_OLD = (
    _statements("2")
    .replace("Small2 = ", "Small2 = 'print' ('>>' E ','?)? Es? | 'exec' E ('in' Es)? | 'raise' E ',' E (',' E)? | ")
    .replace("Except2 = ", "Except2 = 'except' E ',' Id ':' Suite2 | ")
)
#: Both dialects in one grammar: File3 and File2 run together over the same expressions.
PYTHON = _PYTHON_EXPRESSIONS + _statements("3") + "\n".join(line for line in _OLD.splitlines() if not line.startswith(("Decorator =", "AugOp =")))

JSON = """
Top = Value
Value = s | 0 | 'true' | 'false' | 'null' | '-' 0 | {:Pairs} | [:Values]
Pairs = | Pair (',' Pair)*
Pair = s ':' Value
Values = | Value (',' Value)*
"""

#: Documents of YAML: ⟨⟩ is what stands deeper than its key or dash, ¶ the end of an entry, d the dash of an item,
#: k the colon of a key, a plain scalar, s quoted scalar, b block scalar, m the mark between documents.
YAML = """
Top = Nested? (m (Nested | Bare)?)*
Bare = Props? Scalar '¶' | Props '¶' Nested?
Nested = ⟨:Map⟩ | ⟨:Seq⟩ | ⟨:One⟩
One = Props? Scalar '¶' | Props '¶' (Map | Seq | Props? Scalar '¶' | Nested)?
Map = Entry+
Entry = Props? Key? k Value | '?' Value (k Value)? | Props? Key? k Props? '¶' Seq
Seq = Item+
Item = d Value
Value = '¶' | Props? Scalar '¶' | Props? '¶' Nested | Nested | Props '¶'
Props = ('!' | '&')+
Scalar = a | s | '*' | b | {:Flow} | [:FlowSeq]
Key = a | s | '*'
Flow = | Pair (',' Pair)* ','?
Pair = Props? FlowKey (k FlowNode?)? | '?' Pair? | k FlowNode?
FlowKey = a | s | '*' | {:Flow} | [:FlowSeq]
FlowSeq = | FlowItem (',' FlowItem)* ','?
FlowItem = FlowNode | Pair
FlowNode = Props? (a | s | '*' | {:Flow} | [:FlowSeq]) | Props
"""
