"""Generalised LL recognition with a graph-structured stack, over token classes with folded brackets.

A token is one character. A bracket pair (indentation counts as one) is folded, innermost first, into one character that
stands for the set of rules its content satisfies: contents that satisfy the same rules are the same token. So there are
as many of these as sets of rules occur, however large a file is, nesting needs no recursion, and repeated code is
recognised once per worker however many files hold it.
"""

from __future__ import annotations

import re

_OPEN = {"(": ")", "[": "]", "{": "}", "⟨": "⟩"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_SYMBOL = re.compile(r"'[^']+'|[(\[{⟨]:\w+[)\]}⟩]|\w+|[()|?*+]")

#: Runs of equal list items; every list rule that takes two takes any number.
_RUNS = [(re.compile(r"(?<![^,])-?(.),(?:-?\1,){2,}"), r"\1,\1,"), (re.compile(r"(.:.,)\1{2,}"), r"\1\1"), (re.compile(r"(.\+)\1{2,}"), r"\1\1")]


def shorten(text: str) -> str:
    """Token text with runs of equal items (data tables, joined literals) cut to two."""
    if "," in text:
        text = _RUNS[1][0].sub(_RUNS[1][1], _RUNS[0][0].sub(_RUNS[0][1], text))
    if "+" in text:
        text = _RUNS[2][0].sub(_RUNS[2][1], text)
    return text


class Unbalanced(Exception):
    """A bracket without its partner."""


class _Node:
    __slots__ = ("edges", "pops")

    def __init__(self) -> None:
        self.edges: dict = {}
        self.pops: set[int] = set()


class Grammar:
    """Rules `Name = alternatives`, one per line; 'x' is a token, (:X) a bracket pair whose content is an X.

    Plain lower-case names are token classes. `lists` names rules that are sequences of their parts, with the rule that
    all parts but the last satisfy; their content is recognised part by part first, and as a whole if a part fails.
    """

    #: Characters that the caches of a worker hold; they may be emptied at any time without changing a result.
    CACHED = 40_000_000

    def __init__(self, rules: str, lists: dict[str, str] | None = None, goes_on: str = "", lines: bool = False):
        self.names: dict[str, int] = {}
        self.alts: list[list[tuple]] = []
        self.codes: dict[str, str] = {}
        self.bits: dict[str, dict[int, int]] = {b: {} for b in _OPEN}
        self.kind_of: dict[str, str] = {}
        self.mask_of: dict[str, int] = {}
        self.class_of: dict[tuple[str, int], str] = {}
        self.folded: dict[str, str] = {}
        self.memo: dict[tuple[tuple[int, ...], str], int] = {}
        self.held = 0
        bodies = re.findall(r"^(\w+) =[ ]?(.*)$", rules, re.M)
        for name, _ in bodies:
            self._rule(name)
        for name, body in bodies:
            parts = _SYMBOL.findall(body)
            alts, rest = self._alternatives(parts, 0)
            assert rest == len(parts), (name, body)
            self.alts[self.names[name]] = alts
        self._tables()
        self.lists = {self.names[k]: self.names[v] for k, v in (lists or {}).items()}
        self.goes_on = {self.codes.get(w, w) for w in goes_on.split()}
        self.lines = lines
        self.bracket_rules = {b: tuple(r) for b, r in self.bits.items()}

    def _rule(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.alts)
            self.alts.append([])
        return self.names[name]

    def code(self, token: str) -> str:
        """The character of a token; words and longer operators get one of their own."""
        if len(token) == 1 and not token.isalpha():
            return token
        if token not in self.codes:
            self.codes[token] = chr(0xE000 + len(self.codes))
        return self.codes[token]

    def _fresh(self, alts: list[tuple]) -> int:
        self.alts.append(alts)
        return len(self.alts) - 1

    def _alternatives(self, parts: list[str], i: int) -> tuple[list[tuple], int]:
        alts, current = [], []
        while i < len(parts) and parts[i] != ")":
            p = parts[i]
            if p == "|":
                alts.append(tuple(current))
                current = []
                i += 1
                continue
            if p == "(":
                inner, behind = self._alternatives(parts, i + 1)
                symbol: object = self._fresh(inner)
                i = behind - 1
            elif p[0] == "'":
                symbol = self.code(p[1:-1])
            elif len(p) > 2 and p[1] == ":":
                rules = self.bits[p[0]]
                symbol = p[0], rules.setdefault(self._rule(p[2:-1]), 1 << len(rules))
            elif p[0].isupper():
                symbol = self._rule(p)
            else:
                symbol = self.code(p)
            i += 1
            if i < len(parts) and parts[i] in "?*+":
                if parts[i] == "?":
                    current.append(self._fresh([(symbol,), ()]))
                else:
                    again = "*", symbol if isinstance(symbol, int) else self._fresh([(symbol,)])
                    current += [again] if parts[i] == "*" else [symbol, again]
                i += 1
            else:
                current.append(symbol)
        alts.append(tuple(current))
        return alts, i + 1 if i < len(parts) and parts[i] == ")" else i

    def _tables(self) -> None:
        """For each rule and next kind of token, the alternatives that can begin with it or be empty."""
        size = len(self.alts)
        nullable, first = [False] * size, [set() for _ in range(size)]
        changed = True
        while changed:
            changed = False
            for i, alts in enumerate(self.alts):
                for alt in alts:
                    begins, empty = self._begins(alt, nullable, first)
                    if not begins <= first[i] or (empty and not nullable[i]):
                        first[i] |= begins
                        nullable[i] |= empty
                        changed = True
        self.predict: list[dict[str, list[tuple]]] = []
        self.empties: list[list[tuple]] = []
        for alts in self.alts:
            table: dict[str, list[tuple]] = {}
            ends = []
            for alt in alts:
                begins, empty = self._begins(alt, nullable, first)
                for k in begins:
                    table.setdefault(k, []).append(alt)
                if empty:
                    ends.append(alt)
            for found in table.values():
                found += [a for a in ends if a not in found]
            self.predict.append(table)
            self.empties.append(ends)

    @staticmethod
    def _begins(alt: tuple, nullable: list[bool], first: list[set]) -> tuple[set, bool]:
        begins: set = set()
        for symbol in alt:
            if isinstance(symbol, int):
                begins |= first[symbol]
                if not nullable[symbol]:
                    return begins, False
            elif isinstance(symbol, tuple) and symbol[0] == "*":
                begins |= first[symbol[1]]
            else:
                begins.add(symbol[0] if isinstance(symbol, tuple) else symbol)
                return begins, False
        return begins, True

    # --- folding ---

    def fold(self, bracket: str, inside: str) -> str:
        """The character of a bracket pair: the set of rules that its content satisfies, found in one run."""
        key = bracket + inside
        ch = self.folded.get(key)
        if ch is None:
            rules, mask = self.bits[bracket], 0
            found = self._verdict(self.bracket_rules[bracket], inside)
            for i, bit in enumerate(rules.values()):
                if found >> i & 1:
                    mask |= bit
            ch = self.class_of.get((bracket, mask))
            if ch is None:
                ch = self.class_of[bracket, mask] = chr(0xF0000 + len(self.class_of))
                self.kind_of[ch], self.mask_of[ch] = bracket, mask
            self._hold(key)
            self.folded[key] = ch
        return ch

    def _hold(self, text: str) -> None:
        """Makes room for one more text in the caches."""
        self.held += len(text) + 100
        if self.held > self.CACHED:
            self.folded.clear()
            self.memo.clear()
            self.held = 0

    def folded_text(self, tokens: list[str]) -> str:
        """Tokens as a string with every bracket pair folded, innermost first."""
        stack: list[tuple[str, list[str]]] = []
        here: list[str] = []
        known = self.folded
        for t in tokens:
            if t in _OPEN:
                stack.append((t, here))
                here = []
            elif t in _CLOSE:
                if not stack or stack[-1][0] != _CLOSE[t]:
                    raise Unbalanced(t)
                bracket, outer = stack.pop()
                raw = bracket + "".join(here)
                ch = known.get(raw)
                if ch is None:  # seen for the first time as it stands: runs are cut before it is looked up again
                    ch = self.fold(bracket, shorten(raw[1:]))
                    self._hold(raw)
                    known[raw] = ch
                outer.append(ch)
                here = outer
            else:
                here.append(t)
        if stack:
            raise Unbalanced(stack[-1][0])
        return shorten("".join(here))

    # --- recognition ---

    def accepts(self, names: str | tuple[str, ...], text: str) -> bool:
        """Whether one of the rules takes the text; several (dialects) run together on one stack."""
        return bool(self._verdict(tuple(self.names[n] for n in ((names,) if isinstance(names, str) else names)), text))

    def _verdict(self, rules: tuple[int, ...], text: str) -> int:
        """Bits of the rules that take the text."""
        key = rules, text
        known = self.memo.get(key)
        if known is None:
            cut = [i for i, r in enumerate(rules) if r in self.lists]
            parts = self._parts(text) if cut else None
            if parts:
                by_part = self._by_parts(tuple(rules[i] for i in cut), parts)
                known = sum(1 << i for k, i in enumerate(cut) if by_part >> k & 1)
                # what isn't a list of parts, and lists with a part that fails, are seen as a whole
                rest = [i for i in range(len(rules)) if not known >> i & 1]
                if rest:
                    whole = self._recognise(tuple(rules[i] for i in rest), text)
                    known |= sum(1 << i for k, i in enumerate(rest) if whole >> k & 1)
            else:
                known = self._recognise(rules, text)
            self._hold(text)
            self.memo[key] = known
        return known

    def _by_parts(self, rules: tuple[int, ...], parts: list[str]) -> int:
        inner = tuple(self.lists[r] for r in rules)
        all_ = known = (1 << len(rules)) - 1
        for part in parts[:-1]:
            known &= self._verdict(inner, part) if inner == rules else self._one_by_one(inner, part)
            if not known:
                return 0
        return known & self._verdict(rules, parts[-1]) & all_

    def _one_by_one(self, rules: tuple[int, ...], part: str) -> int:
        once = tuple(dict.fromkeys(rules))
        found = self._verdict(once, part)
        return sum(1 << i for i, r in enumerate(rules) if found >> once.index(r) & 1)

    def _parts(self, text: str) -> list[str] | None:
        """Pieces behind ends of statements that the next token doesn't go on with; None if it is one piece."""
        parts, start, kinds, on = [], 0, self.kind_of, self.goes_on
        if self.lines:
            line = 0
            for i in range(len(text) - 1):
                ch, after = text[i], text[i + 1]
                if ch == "¶" or kinds.get(ch) == "⟨":
                    if after not in on and kinds.get(after) != "⟨" and text[line] != "@":
                        parts.append(text[start : i + 1])
                        start = i + 1
                    line = i + 1
        else:
            for i in range(len(text) - 1):
                ch = text[i]
                if ch == ";" or (ch in kinds and kinds[ch] == "{" and text[i + 1] not in on and text[i + 1] not in kinds):
                    parts.append(text[start : i + 1])
                    start = i + 1
        if not parts:
            return None
        parts.append(text[start:])
        return parts

    def _recognise(self, rules: tuple[int, ...], text: str) -> int:
        """One run of all rules over one graph-structured stack; repetition loops in its slot, so lists take linear time."""
        kind_of, masks, size = self.kind_of, self.mask_of, len(text)
        predict, empties = self.predict, self.empties
        kinds = [kind_of.get(ch, ch) for ch in text]
        kinds.append("")
        nodes: dict[tuple[int, int], _Node] = {}
        roots: dict[int, int] = {}
        work = []
        for i, rule in enumerate(rules):
            root = nodes.get((rule, 0))
            if root is None:
                root = nodes[rule, 0] = _Node()
                work += [(alt, 0, root, 0) for alt in predict[rule].get(kinds[0], empties[rule])]
            roots[id(root)] = roots.get(id(root), 0) | 1 << i
        every, found = (1 << len(rules)) - 1, 0
        loops: set = set()
        while work:
            alt, dot, node, at = work.pop()
            while True:
                if dot == len(alt):
                    if at == size and id(node) in roots:
                        found |= roots[id(node)]
                        if found == every:
                            return found
                    if at not in node.pops:
                        node.pops.add(at)
                        for back_alt, back_dot, back in node.edges.values():
                            work.append((back_alt, back_dot, back, at))
                    break
                symbol = alt[dot]
                if isinstance(symbol, str):
                    if at == size or text[at] != symbol:
                        break
                    dot += 1
                    at += 1
                    continue
                if isinstance(symbol, int):
                    called, back_to = symbol, dot + 1
                elif symbol[0] == "*":
                    slot = id(alt), dot, id(node), at
                    if slot in loops:
                        break
                    loops.add(slot)
                    called, back_to = symbol[1], dot
                else:
                    if kinds[at] != symbol[0] or not masks[text[at]] & symbol[1]:
                        break
                    dot += 1
                    at += 1
                    continue
                leaves = back_to == dot
                choices = predict[called].get(kinds[at], empties[called])
                if choices:
                    key = called, at
                    child = nodes.get(key)
                    edge = id(alt), dot, id(node)
                    if child is None:
                        child = nodes[key] = _Node()
                        child.edges[edge] = alt, back_to, node
                        for a in choices:
                            work.append((a, 0, child, at))
                    elif edge not in child.edges:
                        child.edges[edge] = alt, back_to, node
                        for end in child.pops:
                            work.append((alt, back_to, node, end))
                if not leaves:
                    break
                dot += 1  # the loop is left here as well as gone through again
        return found
