"""What counts as a block in each language, stated as data.

A rule is ``(node type, pattern, end[, options])``. The pattern is matched at the start of
a unit (a statement, line, tag or bracket, see ``lexing``) whose comments and
strings are masked; group 1 is what precedes the block, group 2 its name. A
rule without group 2 yields an anonymous block.

End of a block: ``block`` is the unit that closes what the header opens, or
the header itself where it opens nothing; ``body`` is the same but demands that
something is opened; ``self`` is the header unit; ``head`` the header without
its opening brace; ``tail`` extends ``block`` over a closing ``;``; ``value`` is a scalar before its
separator. ``decorated``, ``sequence`` and ``first`` are blocks that count only
after a decorator, as the first of their siblings, and as the file's first unit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Rule = tuple[str, str, str]

# Blanks and masked comments, then annotations on the same line.
_BLANK = r"[\s\x01\x04]*"
_WS = _BLANK + r"(?:@(?!(?:interface|implementation|protocol)\b)[\w.]+(?:\([^()]*\))?[\s\x01\x04]+)*+"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|partial|readonly|synchronized|native|default|extern|unsafe|new|strictfp|required|inline|constexpr|explicit|friend)\s+)*+"
_NOT_STATEMENT = r"(?!(?:return|new|else|throw|await|yield|case|goto|delete|typeof|using|import|package|in|is|as|do)\b)"
_CONTROL = r"(?!(?:if|for|while|switch|catch|function|return|with|do|else|new|super|typeof|await|throw|foreach|lock|using|when|match|unless|until|elseif|synchronized|sizeof|class|defer|guard)\b)"
_TYPED = _NOT_STATEMENT + r"[\w.<>\[\],?&*:~][\w.<>\[\],?&*:~\s]*(?<=[\s>\]*&])"

# A tuple is a type, and may stand among a type's arguments.
_MEMBER = r"(?=\w+\s*[(<{])"
_MEMBER_TYPE = rf"(?:\([^(){{}};]*\)\??\s+{_MEMBER}|{_NOT_STATEMENT}[\w.]+<[^;{{}}=]*>[\[\]?]*\s+{_MEMBER}|{_TYPED})"


@dataclass(frozen=True)
class Language:
    """Lexical style and block rules of one language."""

    style: str
    family: str
    rules: list[Rule]
    options: dict[str, str] = field(default_factory=dict)

    @property
    def nested(self) -> bool:
        """Whether brackets are matched before units are cut."""
        return self.family == "brace" and self.style in ("c", "rust", "script")


def _named(node: str, head: str, name: str = r"[\w$]+", end: str = "block", before: str = "") -> Rule:
    return node, rf"^({_WS}{before}){head}({name})", end


_EXPORT = r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?"
_ARROW = r"\s*(?::[^=\n]*+(?:=>[^=\n]*+)*+)?=\s*(?:async\s*)?(?:<[^=(\n]*>\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+?)?=>"
_METHOD = (
    "method_definition",
    rf"^({_WS})(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+(?![(<]))*+\*?\s*{_CONTROL}([\w$]+)\s*(?:<[^(\n]*>)?\([^;]*\)\s*(?::[^;=]+)?\{{\z",
    "body",
)

_JS = [
    _named("class_declaration", r"class\s+", before=_EXPORT),
    _METHOD,
    _named("function_declaration", r"(?:async\s+)?function\s+", before=_EXPORT),
    ("lexical_declaration", rf"^({_WS}{_EXPORT})(?:const|let)\s+[\w$]+{_ARROW}", "tail"),
]
_TS = [
    *_JS,
    _named("interface_declaration", r"interface\s+", before=_EXPORT),
    _named("type_alias_declaration", r"type\s+", r"[\w$]+(?=\s*[<=])", "tail", before=_EXPORT),
    _named("enum_declaration", r"(?:const\s+)?enum\s+", before=_EXPORT),
]

LANGUAGES: dict[str, Language] = {
    "typescript": Language("script", "brace", _TS),
    "tsx": Language("script", "brace", _TS),
    "javascript": Language(
        "script",
        "brace",
        [*_JS, ("variable_declaration", rf"^({_WS}{_EXPORT})var\s+[\w$]+\s*=\s*(?:async\s+)?function\b", "tail")],
    ),
    "python": Language(
        "python",
        "indent",
        [
            _named("class_definition", r"class\s+", r"\w+"),
            _named("function_definition", r"(?:async\s+)?def\s+", r"\w+"),
            ("decorated_definition", rf"^({_WS})(?:async\s+)?def\s", "decorated"),
        ],
    ),
    "java": Language(
        "c",
        "brace",
        [
            _named("class_declaration", rf"{_MODS}class\s+"),
            _named("interface_declaration", rf"{_MODS}interface\s+"),
            (
                "method_declaration",
                rf"^({_WS}){_MODS}(?:<[^>\n]*>\s*)?{_NOT_STATEMENT}(?!class\b|interface\b|enum\b|record\b){_TYPED}([\w$]+)\s*\([^;{{]*\)[^;{{=]*[;{{]\z",
                "block",
            ),
            (
                "constructor_declaration",
                rf"^({_WS})(?:(?:public|private|protected)\s+)?([A-Z][\w$]*)\s*\([^;{{]*\)[^;{{=]*\{{\z",
                "body",
            ),
            _named("enum_declaration", rf"{_MODS}enum\s+"),
        ],
    ),
    "kotlin": Language(
        "c",
        "brace",
        [
            _named("class_declaration", r"(?:(?:public|private|protected|internal|open|data|sealed|abstract|inner|enum|annotation|value|fun)\s+)*+(?:class|interface)\s+"),
            _named("function_declaration", r"(?:(?:public|private|protected|internal|open|override|suspend|inline|operator|infix|tailrec|abstract)\s+)*+fun\s+(?:<[^>\n]*>\s*)?(?:[\w.<>?]+\.)?", r"\w+"),
            _named("object_declaration", r"(?:(?:public|private|internal|data)\s+)*+object\s+"),
        ],
    ),
    "scala": Language(
        "c",
        "brace",
        [
            _named("class_definition", r"(?:(?:private|protected|final|sealed|abstract|implicit|case)\s+)*+class\s+"),
            _named("object_definition", r"(?:(?:private|protected|implicit|case)\s+)*+object\s+"),
            _named("trait_definition", r"(?:(?:private|protected|sealed)\s+)*+trait\s+"),
            _named("function_definition", r"(?:(?:private|protected|final|override|implicit|inline)\s+)*+def\s+", r"\w+(?=[^=\n]*=)"),
        ],
    ),
    "c": Language(
        "c",
        "brace",
        [
            ("function_definition", rf"^({_WS})(?!typedef\b){_TYPED}[*\s]*\w+\s*\([^;{{]*\)\s*\{{\z", "body"),
            _named("struct_specifier", r"struct\s+", r"\w+(?=\s*\{\z)", "body", before=r"(?:typedef\s+)?(?:static\s+)?"),
            _named("enum_specifier", r"enum\s+", r"\w+(?=\s*\{\z)", "body", before=r"(?:typedef\s+)?"),
            ("type_definition", rf"^({_WS})typedef\b(?=[^;]*?(\w+)\s*;\z|)", "tail"),
        ],
    ),
    "cpp": Language(
        "c",
        "brace",
        [
            ("function_definition", rf"^({_WS}(?:(?:public|private|protected)\s*:{_WS})?)(?!class\b|struct\b|namespace\b|enum\b|template\b){_MODS}{_TYPED}[*&\s]*\w+\s*\([^;{{]*\)[^;{{]*\{{\z", "body"),
            ("function_definition", rf"^({_WS}(?:(?:public|private|protected)\s*:{_WS})?)(?!class\b|struct\b|namespace\b|enum\b|template\b){_MODS}{_CONTROL}(?:\w+::)*+~?\w+\s*\([^;{{]*\)\s*(?:noexcept\s*)?(?::(?!:)[^;{{]*)?\{{\z", "body"),
            _named("class_specifier", r"class\s+", r"\w+(?=[^;{]*\{\z)", "body", before=r"(?:template\s*<[^{;]*>\s*)?"),
            _named("struct_specifier", r"struct\s+", r"\w+(?=[^;{]*\{\z)", "body", before=r"(?:template\s*<[^{;]*>\s*)?"),
            _named("namespace_definition", r"(?:inline\s+)?namespace\s+", r"\w+(?=\s*\{\z)", "body"),
            ("template_declaration", rf"^({_WS})template\s*<", "tail"),
        ],
    ),
    "csharp": Language(
        "c",
        "brace",
        [
            _named("class_declaration", rf"{_MODS}class\s+"),
            _named("interface_declaration", rf"{_MODS}interface\s+"),
            (
                "method_declaration",
                rf"^({_WS}){_MODS}(?!class\b|interface\b|enum\b|record\b|struct\b|namespace\b|delegate\b){_MEMBER_TYPE}(\w+)\s*(?:<[^>\n]*>)?\s*\([^;{{]*\)[^;{{=]*(?:=>[^;]*)?[;{{]\z",
                "block",
            ),
            ("constructor_declaration", rf"^({_WS})(?:(?:public|private|protected|internal|static)\s+)++([A-Z]\w*)\s*\([^;{{]*\)[^;{{=]*\{{\z", "body"),
            ("property_declaration", rf"^({_WS}){_MODS}(?!class\b|interface\b|enum\b|record\b|struct\b|namespace\b|get\b|set\b|else\b|try\b|finally\b){_MEMBER_TYPE}(\w+)\s*\{{\z", "body"),
            _named("namespace_declaration", r"namespace\s+", r"\w+(?=\s*\{\z)", "body"),
            _named("enum_declaration", rf"{_MODS}enum\s+"),
        ],
        {"context": r"^\s*\[[^\]]*\]\s*\z"},
    ),
    "objc": Language(
        "c",
        "brace",
        [
            _named("class_interface", r"@interface\s+"),
            _named("class_implementation", r"@implementation\s+"),
            ("method_definition", rf"^({_WS})[-+]\s*\([^{{;]*\{{\z", "body"),
            _named("protocol_declaration", r"@protocol\s+", r"\w+(?![\w\s]*;)"),
        ],
        {"opens": r"^\s*@(?:interface|implementation|protocol)\b(?![^\n]*;)", "closes": r"^\s*@end\b", "context": r"^\z"},
    ),
    "go": Language(
        "c",
        "brace",
        [
            _named("function_declaration", r"func\s+", r"\w+"),
            _named("method_declaration", r"func\s*\([^)]*\)\s*", r"\w+"),
            ("type_declaration", rf"^({_WS})type\s+\w+", "block"),
            ("type_declaration", rf"^({_WS})type\s*\{{\z", "body"),
        ],
    ),
    "rust": Language(
        "rust",
        "brace",
        [
            _named("function_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\x02+)?)\s+)*+fn\s+", r"\w+(?=[^;]*\{\z)", "body"),
            ("impl_item", rf"^({_WS})(?:unsafe\s+)?impl\b(?:<[^{{]*?>)?\s*(?:[^{{]*?\bfor\s+)?(\w+)?(?=[^{{;]*\{{\z)", "body"),
            _named("struct_item", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+"),
            _named("enum_item", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+"),
            _named("trait_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+"),
            _named("mod_item", r"(?:pub(?:\([^)]*\))?\s+)?mod\s+"),
        ],
    ),
    "zig": Language(
        "rust",
        "brace",
        [
            _named("FnProto", r"fn\s+", r"\w+", "head", before=r"(?:pub\s+)?(?:export\s+|inline\s+)?"),
            ("ContainerDecl", rf"^({_WS}[^{{;]*?)(?:packed\s+|extern\s+)?(?:struct|enum|union)\b[^{{;]*\{{\z", "body"),
            _named("VarDecl", r"(?:const|var)\s+", r"\w+", "tail", before=r"(?:pub\s+)?"),
        ],
    ),
    "swift": Language(
        "c",
        "brace",
        [
            _named("class_declaration", r"(?:(?:public|private|internal|fileprivate|open|final)\s+)*+(?:class|struct|enum|actor|extension)\s+"),
            _named("function_declaration", r"(?:(?:public|private|internal|fileprivate|open|final|static|class|override|mutating|async)\s+)*+func\s+", r"\w+(?=[^;]*\{\z)", "body"),
            _named("protocol_declaration", r"(?:(?:public|private|internal|fileprivate)\s+)?protocol\s+"),
        ],
    ),
    "dart": Language(
        "script",
        "brace",
        [
            _named("class_definition", r"(?:(?:abstract|base|final|sealed|mixin)\s+)*+class\s+"),
            ("method_signature", rf"^(\s+)(?!class\b|enum\b)(?:static\s+)?{_TYPED}{_CONTROL}(\w+)\s*\([^;{{]*\)\s*(?:async\*?\s*)?\{{\z", "head"),
            ("function_signature", rf"^(\n*)(?!class\b|enum\b|[ \t]){_TYPED}{_CONTROL}(\w+)\s*\([^;{{]*\)\s*(?:async\*?\s*)?\{{\z", "head"),
            _named("enum_declaration", r"enum\s+"),
        ],
    ),
    "php": Language(
        "script",
        "brace",
        [
            _named("class_declaration", r"(?:(?:abstract|final|readonly)\s+)*+class\s+", before=r"(?:<\?php\s+)?"),
            _named("interface_declaration", r"interface\s+", before=r"(?:<\?php\s+)?"),
            ("function_definition", rf"^({_WS}(?:<\?php\s+)?)(?<![ \t])function\s+&?(\w+)", "block"),
            ("method_declaration", rf"^(\s*(?=[ \t]))(?:(?:public|private|protected|static|final|abstract)\s+)*+function\s+&?(\w+)", "block"),
            _named("trait_declaration", r"trait\s+", before=r"(?:<\?php\s+)?"),
        ],
    ),
    "solidity": Language(
        "c",
        "brace",
        [
            _named("contract_declaration", r"(?:abstract\s+)?contract\s+"),
            _named("function_definition", r"function\s+"),
            _named("event_definition", r"event\s+"),
            _named("struct_declaration", r"struct\s+"),
            _named("interface_declaration", r"interface\s+"),
        ],
    ),
    "rescript": Language(
        "c",
        "brace",
        [
            _named("let_binding", "", r"\w+(?=\s*[:=])", "block", before=r"let\s+(?:rec\s+)?"),
            _named("type_declaration", r"type\s+(?:rec\s+)?"),
            _named("module_declaration", r"module\s+(?:type\s+)?"),
        ],
    ),
    "css": Language(
        "css",
        "brace",
        [
            ("rule_set", rf"^({_BLANK}+)(?![\s@]|\}}|(?:from|to|[\d.]+%)\s*[,{{])([^{{}};@]*[^{{}};@\s])\s*\{{\z", "body"),
            ("media_statement", rf"^({_BLANK})@media\b", "body"),
            ("keyframes_statement", rf"^({_BLANK})@(?:-\w+-)?keyframes\s+([\w-]+)", "body"),
        ],
        {"split": r"(?<=[{};])", "context": r"^\z"},
    ),
    "systemrdl": Language(
        "c",
        "brace",
        [
            ("component_def", rf"^({_WS})(?:addrmap|regfile|reg|mem|signal)\b[^{{;]*\{{\z", "tail"),
            ("field_def", rf"^({_WS})field\b[^{{;]*\{{\z", "tail"),
        ],
    ),
    "bash": Language(
        "shell",
        "brace",
        [
            ("function_definition", rf"^({_WS})(?=function\s|[\w-]+\s*\()(?:function\s+)?([\w-]+)\s*(?:\(\s*\))?\s*\{{\z", "body"),
            _named("variable_assignment", "", r"\w+(?=\+?=)", "self", before=r"(?:(?:export|local|readonly|declare)\s+)?"),
        ],
        {"split": r"(?<=[{};\n])", "context": r"^\z"},
    ),
    "ruby": Language(
        "shell",
        "keyword",
        [
            _named("class", r"class\s+", r"[A-Z]\w*(?!\w*::)"),
            _named("module", r"module\s+", r"[A-Z]\w*(?!\w*::)"),
            _named("method", r"def\s+", r"[a-z_]\w*[?!=]?(?![\w.])"),
            ("singleton_method", rf"^({_WS})def\s+\w+\.(\w+[?!]?)", "block"),
        ],
        {
            "opens": r"(?m)(?:^|[=(;])\s*(?:class|module|def|if|unless|while|until|for|case|begin)\b|\bdo\b",
            "closes": r"\bend\b",
        },
    ),
    "lua": Language(
        "lua",
        "keyword",
        [
            ("function_declaration", rf"^({_WS})function\s+([\w.]+)(?=\s*\()", "block"),
            _named("local_function_declaration", r"local\s+function\s+", r"\w+"),
        ],
        {"opens": r"\b(?:function|if|do|repeat)\b", "closes": r"\b(?:end|until)\b"},
    ),
    "elixir": Language(
        "shell",
        "keyword",
        [
            ("call", rf"^({_WS})defmodule\s+[A-Z]", "block"),
            ("call", rf"^({_WS})def(?!module\b)\w*\s+\w+[?!]?\(", "block"),
        ],
        {"opens": r"\bdo\b(?!:)|\bfn\b", "closes": r"\bend\b"},
    ),
    "ocaml": Language(
        "ocaml",
        "indent",
        [
            _named("let_binding", "", r"[a-z_][\w']*(?=[^=]*=)", "block", before=r"(?:let|and)\s+(?:rec\s+)?"),
            _named("type_binding", "", r"[a-z_]\w*", "block", before=r"type\s+(?:nonrec\s+)?(?:\([^)]*\)\s*|'\w+\s+)?"),
            _named("module_binding", "", r"[A-Z]\w*", "block", before=r"module\s+(?:rec\s+)?(?!type\b)"),
        ],
        {"closes": r"\A\s*end\b"},
    ),
    "yaml": Language(
        "yaml",
        "yaml",
        [
            ("block_mapping_pair", r"^(\s*(?:-\s+)*)([^\s#:\-][^:#\n]*|\x02+):\s*(?:[|>][+-]?\d?)?\s*\z", "block"),
            ("block_mapping_pair", r"^(\s*(?:-\s+)*)([^\s#:\-][^:#\n]*|\x02+):\s+(?![|>][+-]?\d?\s*\z)\S", "self"),
            ("block_sequence", r"^(\s*)-(?=\s|\z)", "sequence"),
        ],
    ),
    "toml": Language(
        "shell",
        "heading",
        [
            _named("table", r"\[", r"[\w-]+(?=\])", before=r""),
            _named("table_array_element", r"\[\[", r"[\w-]+(?=\]\])"),
            _named("pair", "", r"[\w-]+(?=\s*=)", "self"),
        ],
        {"split": r"(?<=\n)(?<![,\[{(]\n)(?!\s*[\]}])", "heading": r"^\s*\["},
    ),
    "markdown": Language(
        "markdown",
        "heading",
        [
            ("atx_heading", r"^([ ]{0,3})#{1,6}(?=[ \t\n]|\z)", "self"),
            ("fenced_code_block", r"^()\x03", "self"),
            ("section", r"^([ ]{0,3})#{1,6}(?=[ \t\n]|\z)", "block"),
            ("section", r"^(\s*)(?=\S)(?![ ]{0,3}#{1,6}(?:[ \t\n]|\z))", "first"),
        ],
        {"context": r"^\z"},
    ),
    "tlaplus": Language(
        "tla",
        "heading",
        [
            ("module", r"^(\s*)-{4,}\s*MODULE\s+(\w+)", "block"),
            ("operator_definition", rf"^({_WS})(\w+)\s*(?:\([^)]*\))?\s*==", "block"),
        ],
        {"heading": r"^\s*-{4,}\s*MODULE", "subheading": r"^\s*(?:={4,}|\w+\s*(?:\([^)]*\))?\s*==|(?:VARIABLES?|CONSTANTS?|THEOREM|ASSUME|EXTENDS)\b|-{4,})"},
    ),
    "elisp": Language(
        "lisp",
        "paren",
        [
            _named("function_definition", r"\((?:defun|defsubst)\s+", r"[^\s()]+"),
            ("special_form", r"^(\s*)\((?:and|catch|cond|condition-case|defconst|defvar|function|if|interactive|lambda|let\*?|or|prog1|prog2|progn|quote|save-current-buffer|save-excursion|save-restriction|setq|setq-default|unwind-protect|while)(?=[\s()])", "block"),
        ],
    ),
    "html": Language(
        "html",
        "tag",
        [
            ("script_element", r"(?i)^()<script\b", "self"),
            ("style_element", r"(?i)^()<style\b", "self"),
            ("element", r"(?si)^()<(?!script\b|style\b|[/!])[^>]*?\sid\s*=\s*[\"']", "block"),
        ],
        {"context": r"^\z"},
    ),
    "vue": Language(
        "html",
        "tag",
        [
            ("script_element", r"(?i)^()<script\b", "self"),
            ("style_element", r"(?i)^()<style\b", "self"),
            ("template_element", r"(?i)^()<template\b", "block"),
        ],
        {"context": r"^\z"},
    ),
    "embedded_template": Language(
        "template",
        "token",
        [("output_directive", r"^()<%=", "self"), ("directive", r"^()<%(?![=#%])", "self"), ("content", r"^()(?!<%)", "self")],
        {"context": r"^\z"},
    ),
    "json": Language(
        "json",
        "json",
        [
            ("pair", r"^(\s*)(\x02+)\s*:\s*[\[{]\z", "block"),
            ("pair", r"^(\s*)(\x02+)\s*:(?!\s*[\[{]\z)", "value"),
            ("object", r"^([^{]*)(?=\{\z)", "block"),
        ],
        {"context": r"^\z"},
    ),
}
