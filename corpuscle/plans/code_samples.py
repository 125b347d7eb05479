"""Small sources in every language, with the name, type, first and last line of each block in them."""

from __future__ import annotations

SAMPLES = {
    'a.ts': (
        "import q from 'q';\n// keeps { a brace\n/** Counts. */\n@Service()\nexport class Meter {\n  // one\n  @Log()\n  tick(): void {\n    this.n += '{ }'.length;\n  }\n  get total(): number { return this.n; }\n}\nexport const twice = (n: number): number => {\n  return 2 * n;\n};\ninterface Unit { sign: string }\ntype Scale = 'si' | 'us';\nenum Base { Two, Ten }\nasync function load(\n  from: string,\n  to: string,\n): Promise<void> {\n  if (from) { to; }\n}\n",
        [
            ('Meter', 'class_declaration', 5, 12),
            ('tick', 'method_definition', 6, 10),
            ('total', 'method_definition', 11, 11),
            ('anonymous', 'lexical_declaration', 13, 15),
            ('Unit', 'interface_declaration', 16, 16),
            ('Scale', 'type_alias_declaration', 17, 17),
            ('Base', 'enum_declaration', 18, 18),
            ('load', 'function_declaration', 19, 24),
        ],
    ),
    'nested.ts': (
        "const open = async ({ page, size = { w: 1 } }) => {\n  await page;\n};\nexport const shut = ({\n  page,\n  deep: [{ a }],\n}: { page: string; deep: { a: number }[] }): Promise<{ ok: boolean }> => {\n  return page;\n};\nclass Door {\n  constructor({ lock }: { lock: Lock }, n = f({ a: 1 })) {\n    super({ lock });\n  }\n  turn({ by, at = (1 + 2) }: Turn, ...rest: (string | { k: string })[]): { by: number } {\n    for (let i = 0; i < by; i++) { rest; }\n    return { by };\n  }\n}\nfunction each(list: Array<{ id: string }>, call: (x: { id: string }) => void) {\n  list.forEach(({ id }) => { call({ id }); });\n}\nconst later: (x: number) => string = (x) => {\n  return `${x}`;\n};\nit('runs', async ({ page }) => {\n  class Inner { go({ a }) { return a; } }\n});\n",
        [
            ('anonymous', 'lexical_declaration', 1, 3),
            ('anonymous', 'lexical_declaration', 4, 9),
            ('Door', 'class_declaration', 10, 18),
            ('constructor', 'method_definition', 11, 13),
            ('turn', 'method_definition', 14, 17),
            ('each', 'function_declaration', 19, 21),
            ('anonymous', 'lexical_declaration', 22, 24),
            ('Inner', 'class_declaration', 26, 26),
            ('go', 'method_definition', 26, 26),
        ],
    ),
    'nested.tsx': (
        "export const Panel = ({ title, items = [{ id: 1 }] }: Props) => {\n  const pick = ({ id }: Item) => { return id; };\n  return <ul onClick={() => pick(items[0])}>{title}</ul>;\n};\n",
        [('anonymous', 'lexical_declaration', 1, 4), ('anonymous', 'lexical_declaration', 2, 2)],
    ),
    'nested.js': (
        "const run = ({ a, b = [{ c: 1 }] }, [d, { e }]) => {\n  return a;\n};\nfunction walk({ from, to }, done = ({ ok }) => { ok; }) {\n  while (from) { to; }\n}\nclass Path { step({ x = 0, y = 0 } = {}) { return [x, y]; } }\n",
        [
            ('anonymous', 'lexical_declaration', 1, 3),
            ('walk', 'function_declaration', 4, 6),
            ('Path', 'class_declaration', 7, 7),
            ('step', 'method_definition', 7, 7),
        ],
    ),
    'Nested.java': (
        "@A @B @C({\"x\", \"y\"}) @D(@E(1)) @F @G @H @I(v = {1, 2}) @J public class Many {\n  @Query(value = {\n    \"a\",\n    \"b\"\n  })\n  public final synchronized strictfp Map<String, List<Integer>> find(@Size({1}) int a, int[] b) throws X {\n    for (int i = 0; i < a; i++) { b[i] = 0; }\n    return null;\n  }\n}\n",
        [('Many', 'class_declaration', 1, 10), ('find', 'method_declaration', 2, 9)],
    ),
    'nested.cpp': (
        "class V {\n public:\n  V(int a) : a_(a), b_{a, 2} {}\n  explicit V(std::map<int, int> m = {{1, 2}}) noexcept : a_{0} {\n    for (int i = 0; i < 3; ++i) { a_ += i; }\n  }\n  ~V() { done(); }\n};\nV::V(double d) : a_(int(d)) {\n  if (d > 0) { a_ = 1; }\n}\n",
        [
            ('V', 'class_specifier', 1, 8),
            ('anonymous', 'function_definition', 3, 3),
            ('anonymous', 'function_definition', 4, 6),
            ('anonymous', 'function_definition', 7, 7),
            ('anonymous', 'function_definition', 9, 11),
        ],
    ),
    'nested.cs': (
        "class Pair {\n  [Theory(Data = new[] { 1, 2 })]\n  public static (int a, string b) Get(int x) { return (x, \"\"); }\n  private async Task<(int, string)> LoadAsync(List<(int, int)> at) {\n    for (var i = 0; i < 3; i++) { at.Add((i, i)); }\n    return (1, \"\");\n  }\n  public (int, int) Range { get; set; }\n}\n",
        [
            ('Pair', 'class_declaration', 1, 9),
            ('Get', 'method_declaration', 2, 3),
            ('LoadAsync', 'method_declaration', 4, 7),
            ('Range', 'property_declaration', 8, 8),
        ],
    ),
    'nested.go': (
        "package p\n\ntype (\n\tShape struct {\n\t\tname string\n\t}\n\tArea func(a int, b struct{ c int }) int\n)\n\ntype One struct{ a int }\n\nfunc (s *Shape) Grow(by struct {\n\tn int\n}, f func() error) (out int, err error) {\n\tfor i := 0; i < by.n; i++ {\n\t\tout++\n\t}\n\treturn\n}\n",
        [
            ('anonymous', 'type_declaration', 3, 8),
            ('anonymous', 'type_declaration', 10, 10),
            ('Grow', 'method_declaration', 12, 19),
        ],
    ),
    'b.py': (
        "# head\n@dec\ndef f(a,\n      b):\n    '''doc: def x'''\n    return 1\n\nclass C:\n    # note\n    @property\n    def p(self):\n        pass\n\n    async def q(self): pass\nx = 1\n",
        [
            ('f', 'function_definition', 1, 6),
            ('anonymous', 'decorated_definition', 1, 6),
            ('C', 'class_definition', 8, 14),
            ('p', 'function_definition', 9, 12),
            ('anonymous', 'decorated_definition', 9, 12),
            ('q', 'function_definition', 14, 14),
        ],
    ),
    'Tally.java': (
        'package t;\npublic class Tally extends Base {\n    @Override\n    public static int add(int[] xs) {\n        log("{ sum }");\n        return sum(xs);\n    }\n    Tally() { }\n    interface Sink { void put(int x); }\n}\n',
        [
            ('Tally', 'class_declaration', 2, 10),
            ('add', 'method_declaration', 3, 7),
            ('Tally', 'constructor_declaration', 8, 8),
            ('Sink', 'interface_declaration', 9, 9),
            ('put', 'method_declaration', 9, 9),
        ],
    ),
    'm.go': (
        'package main\n\n// main does\nfunc main() {\n\tfmt.Println("x")\n}\nfunc (s *S) Name() string { return s.n }\ntype S struct {\n\tn string\n}\n',
        [
            ('main', 'function_declaration', 3, 6),
            ('Name', 'method_declaration', 7, 7),
            ('anonymous', 'type_declaration', 8, 10),
        ],
    ),
    'l.rs': (
        'fn start() {\n    run("fn no() {");\n}\nstruct Tank {\n    level: u32,\n}\nimpl Tank {\n    fn fill(by: u32) -> Self { Tank { level: by } }\n}\nimpl<T> Drain for Pipe { }\n',
        [
            ('start', 'function_item', 1, 3),
            ('Tank', 'struct_item', 4, 6),
            ('Tank', 'impl_item', 7, 9),
            ('fill', 'function_item', 8, 8),
            ('Pipe', 'impl_item', 10, 10),
        ],
    ),
    'r.rb': (
        'class A\n  # doc\n  def x(a)\n    if a\n      1\n    end\n  end\n  def self.y; 2; end\nend\n',
        [
            ('A', 'class', 1, 9),
            ('x', 'method', 2, 7),
            ('y', 'singleton_method', 8, 8),
        ],
    ),
    'd.json': (
        '{"a": 1, "b": {"c": [1, {"d": "x"}]}, "e": "f"}',
        [
            ('anonymous', 'object', 1, 1),
            ('"a"', 'pair', 1, 1),
            ('"b"', 'pair', 1, 1),
            ('anonymous', 'object', 1, 1),
            ('"c"', 'pair', 1, 1),
            ('anonymous', 'object', 1, 1),
            ('"d"', 'pair', 1, 1),
            ('"e"', 'pair', 1, 1),
        ],
    ),
    'y.yaml': (
        'a: 1\nb:\n  c: 2\n  d:\n    - x\n    - y: 1\n      z: 2\ne: 3\n',
        [
            ('a', 'block_mapping_pair', 1, 1),
            ('b', 'block_mapping_pair', 2, 7),
            ('c', 'block_mapping_pair', 3, 3),
            ('d', 'block_mapping_pair', 4, 7),
            ('anonymous', 'block_sequence', 5, 7),
            ('y', 'block_mapping_pair', 6, 6),
            ('z', 'block_mapping_pair', 7, 7),
            ('e', 'block_mapping_pair', 8, 8),
        ],
    ),
    't.toml': (
        'x = 1\n[pkg]\nname = "a"\narr = [\n 1,\n 2\n]\n[[bin]]\np = 2\n',
        [
            ('x', 'pair', 1, 1),
            ('pkg', 'table', 2, 7),
            ('name', 'pair', 3, 3),
            ('arr', 'pair', 4, 7),
            ('bin', 'table_array_element', 8, 9),
            ('p', 'pair', 9, 9),
        ],
    ),
    'k.md': (
        'intro\n\n# A\ntext\n## B\n```py\n# no\n\ndef f(): pass\n```\nmore\n# C\nend\n',
        [
            ('anonymous', 'section', 1, 1),
            ('anonymous', 'section', 3, 11),
            ('anonymous', 'atx_heading', 3, 3),
            ('anonymous', 'section', 5, 11),
            ('anonymous', 'atx_heading', 5, 5),
            ('anonymous', 'fenced_code_block', 6, 10),
            ('anonymous', 'section', 12, 13),
            ('anonymous', 'atx_heading', 12, 12),
        ],
    ),
    'h.html': (
        '<html><style>p{}</style><body><div id="x"><div>a</div><p>b</div><script>if(a<b){}</script></body></html>',
        [
            ('anonymous', 'style_element', 1, 1),
            ('anonymous', 'element', 1, 1),
            ('anonymous', 'script_element', 1, 1),
        ],
    ),
    'v.vue': (
        '<template><div><template>x</template></div></template>\n<script>export default {}</script>',
        [
            ('anonymous', 'template_element', 1, 1),
            ('anonymous', 'template_element', 1, 1),
            ('anonymous', 'script_element', 2, 2),
        ],
    ),
    'e.ejs': (
        'a <% if (x) { %>b<%= y %> c',
        [
            ('anonymous', 'content', 1, 1),
            ('anonymous', 'directive', 1, 1),
            ('anonymous', 'content', 1, 1),
            ('anonymous', 'output_directive', 1, 1),
            ('anonymous', 'content', 1, 1),
        ],
    ),
    's.css': (
        '/* c */\n.a, .b:hover { color: red }\n@media (x) { .c { d: e } }\n@keyframes k { from { a: b } }',
        [
            ('.a, .b:hover', 'rule_set', 1, 2),
            ('anonymous', 'media_statement', 3, 3),
            ('.c', 'rule_set', 3, 3),
            ('k', 'keyframes_statement', 4, 4),
        ],
    ),
    'x.lua': (
        'local function f(a)\n  if a then return end\nend\nfunction M.g() end\n',
        [
            ('f', 'local_function_declaration', 1, 3),
            ('M.g', 'function_declaration', 4, 4),
        ],
    ),
    'x.ex': (
        'defmodule A.B do\n  def f(x) do\n    x\n  end\n  defp g(y), do: y\nend\n',
        [
            ('anonymous', 'call', 1, 6),
            ('anonymous', 'call', 2, 4),
            ('anonymous', 'call', 5, 5),
        ],
    ),
    'x.ml': (
        'let f x =\n  x + 1\ntype t = A | B\nmodule M = struct\n  let g = 1\nend\n',
        [
            ('f', 'let_binding', 1, 2),
            ('t', 'type_binding', 3, 3),
            ('M', 'module_binding', 4, 6),
            ('g', 'let_binding', 5, 5),
        ],
    ),
    'x.el': (
        '(defun foo (x)\n  "doc ("\n  (let ((y 1))\n    (setq z y)))\n',
        [
            ('foo', 'function_definition', 1, 4),
            ('anonymous', 'special_form', 3, 4),
            ('anonymous', 'special_form', 4, 4),
        ],
    ),
    'x.sh': (
        '#!/bin/bash\nX=1\nfoo() {\n  local y=2\n  echo $y\n}\nfunction bar {\n echo\n}\n',
        [
            ('X', 'variable_assignment', 1, 2),
            ('foo', 'function_definition', 3, 6),
            ('y', 'variable_assignment', 4, 4),
            ('bar', 'function_definition', 7, 9),
        ],
    ),
    'x.c': (
        '#include <a.h>\n/* doc */\nstatic int *foo(int a, char b) {\n  if (a) { return b; }\n}\nstruct S { int a; };\ntypedef struct { int x; } P;\ntypedef int T;\nenum E { A };\n',
        [
            ('anonymous', 'function_definition', 3, 5),
            ('S', 'struct_specifier', 6, 6),
            ('P', 'type_definition', 7, 7),
            ('T', 'type_definition', 8, 8),
            ('E', 'enum_specifier', 9, 9),
        ],
    ),
    'x.cpp': (
        'namespace n {\ntemplate <typename T>\nclass A : public B {\npublic:\n  void f() { g(); }\n};\nint A::h(int x) const {\n return 1;\n}\n}\n',
        [
            ('n', 'namespace_definition', 1, 10),
            ('anonymous', 'template_declaration', 2, 6),
            ('A', 'class_specifier', 3, 6),
            ('anonymous', 'function_definition', 5, 5),
        ],
    ),
    'x.cs': (
        'namespace N {\n[Attr]\npublic class A {\n  public int X { get; set; }\n  public A(int a) { }\n  public async Task<int> F(int a) { return 1; }\n}\n}\n',
        [
            ('N', 'namespace_declaration', 1, 8),
            ('A', 'class_declaration', 2, 7),
            ('X', 'property_declaration', 4, 4),
            ('A', 'constructor_declaration', 5, 5),
            ('F', 'method_declaration', 6, 6),
        ],
    ),
    'x.kt': (
        'data class P(val x: Int)\nfun f(a: Int): Int {\n return 1\n}\nobject O {\n fun g() = 1\n}\n',
        [
            ('P', 'class_declaration', 1, 1),
            ('f', 'function_declaration', 2, 4),
            ('O', 'object_declaration', 5, 7),
            ('g', 'function_declaration', 6, 6),
        ],
    ),
    'x.swift': (
        'struct S {\n func f() -> Int { return 1 }\n}\nprotocol P { func g() }\n',
        [
            ('S', 'class_declaration', 1, 3),
            ('f', 'function_declaration', 2, 2),
            ('P', 'protocol_declaration', 4, 4),
        ],
    ),
    'x.scala': (
        'object O {\n def f(x: Int): Int = {\n x\n }\n}\ncase class C(a: Int)\ntrait T { def g: Int = 1 }\n',
        [
            ('O', 'object_definition', 1, 5),
            ('f', 'function_definition', 2, 4),
            ('C', 'class_definition', 6, 6),
            ('T', 'trait_definition', 7, 7),
            ('g', 'function_definition', 7, 7),
        ],
    ),
    'x.php': (
        '<?php\nclass A {\n  public function f($a) { return 1; }\n}\nfunction g() { }\n',
        [
            ('A', 'class_declaration', 2, 4),
            ('g', 'function_definition', 5, 5),
        ],
    ),
    'x.sol': (
        'contract C {\n event E(uint a);\n struct S { uint x; }\n function f() public { }\n}\n',
        [
            ('C', 'contract_declaration', 1, 5),
            ('E', 'event_definition', 2, 2),
            ('S', 'struct_declaration', 3, 3),
            ('f', 'function_definition', 4, 4),
        ],
    ),
    'x.dart': (
        'class A {\n  int f(int x) { return x; }\n}\nvoid main() { run(); }\nenum E { a }\n',
        [
            ('A', 'class_definition', 1, 3),
            ('f', 'method_signature', 2, 2),
            ('main', 'function_signature', 4, 4),
            ('E', 'enum_declaration', 5, 5),
        ],
    ),
    'x.zig': (
        'const S = struct {\n  x: i32,\n};\npub fn main() void {\n  var y = 1;\n}\n',
        [
            ('S', 'VarDecl', 1, 3),
            ('anonymous', 'ContainerDecl', 1, 3),
            ('main', 'FnProto', 4, 4),
            ('y', 'VarDecl', 5, 5),
        ],
    ),
    'x.m': (
        '@interface A : B\n- (void)f;\n@end\n@implementation A\n- (void)f {\n  [x y];\n}\n@end\n',
        [
            ('A', 'class_interface', 1, 3),
            ('A', 'class_implementation', 4, 8),
            ('anonymous', 'method_definition', 5, 7),
        ],
    ),
    'x.res': (
        'let f = (a) => {\n  a\n}\ntype t = int\nmodule M = {\n  let g = 1\n}\n',
        [
            ('f', 'let_binding', 1, 3),
            ('t', 'type_declaration', 4, 4),
            ('M', 'module_declaration', 5, 7),
            ('g', 'let_binding', 6, 6),
        ],
    ),
    'x.tla': (
        "---- MODULE M ----\nVARIABLE x\nInit == x = 0\nNext == x' = x + 1\n====\n",
        [
            ('M', 'module', 1, 5),
            ('Init', 'operator_definition', 3, 3),
            ('Next', 'operator_definition', 4, 4),
        ],
    ),
    'x.rdl': (
        'addrmap top {\n  reg {\n    field {} a;\n  } r0;\n};\n',
        [
            ('anonymous', 'component_def', 1, 5),
            ('anonymous', 'component_def', 2, 4),
            ('anonymous', 'field_def', 3, 3),
        ],
    ),
    'Makefile': (
        'all:',
        [
        ],
    ),
    'x.unknown': (
        'class A {}',
        [
        ],
    ),
}

# Languages by family, and what makes a line, or a whole text, a comment in them.
LINES = {
    "script": {"typescript": "//", "tsx": "//", "javascript": "//", "dart": "//", "php": "//", "rescript": "//"},
    "braces": {
        "java": "//", "kotlin": "//", "scala": "//", "c": "//", "cpp": "//", "csharp": "//", "objc": "//", "go": "//",
        "rust": "//", "zig": "//", "swift": "//", "solidity": "//", "systemrdl": "//",
    },
    "words": {"python": "#", "ruby": "#", "lua": "--", "elixir": "#", "bash": "#", "elisp": ";", "tlaplus": "\\*"},
    "data": {"json": "//", "yaml": "#", "toml": "#"},
}
AROUND = {
    "script": {},
    "braces": {},
    "words": {"ocaml": ("(*", "*)")},
    "data": {"css": ("/*", "*/"), "html": ("<!--", "-->"), "vue": ("<!--", "-->"), "embedded_template": ("<%#", "%>")},
}
