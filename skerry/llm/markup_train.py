"""Training of the block labeller: ``python -m skerry.llm.markup_train PLAIN_PARQUET OUT.npz``.

Texts to learn from are composed: plain lines (a bounded, seeded sample of the lines of a
table that hold none of the signs of ``BARE`` at all) get pieces of HTML, Markdown, wiki and
LaTeX markup, whole or broken, and the same signs in their everyday sense, so every leaf's
label is known. Both are drawn from small grammars of the notations with random names,
numbers and words; no text of any table but the plain lines goes in. The network is trained
by back-propagation through all leaves of a text with Adam, in numpy.
"""

from __future__ import annotations

import random
import re
import string
import sys
from html.entities import name2codepoint

import numpy as np

from skerry.llm import markup as M
from skerry.llm.rewrite import ROLES

HIDDEN = 16
R = {name: i for i, name in enumerate(ROLES)}
#: The bounds of the training: plain lines sampled, texts composed.
PLAIN_LINES, TEXTS = 20_000, 10_000
BARE = re.compile(r"[<>&$\\`\[\]{}|=*_~^#@%]|''|--")

PAIRED = "b i em strong u s sup sub small big code span font div q tt kbd cite mark del ins center p abbr a h2 h3 td li section label".split()
ALONE = "br hr wbr img p div li td tr input".split()
ATTRIBUTES = "class id style title href lang align width name data-x".split()
STYLES = "textit textbf emph underline texttt textsc textsf mbox uline".split()
BEHIND = "footnote cite citep label ref index marginpar footnotemark vspace pageref textsuperscript".split()
GREEK = "alpha beta gamma delta lambda mu sigma omega theta pi".split()
SPECIAL = "main seealso efn cn fact quote nowrap lang infobox navbox reflist cite stub update dead".split()


class Maker:
    """Random pieces of notation."""

    def __init__(self, seed: int, lines: list[str]):
        self.rng, self.lines = random.Random(seed), lines

    def of(self, *choices):
        """One of the choices, called if it can be."""
        got = self.rng.choice(choices)
        return got() if callable(got) else got

    def plain(self) -> str:
        return self.rng.choice(self.lines).strip()

    def word(self) -> str:
        return re.sub(r"\W", "", self.rng.choice(self.plain().split(" "))) or "x"

    def words(self, most: int = 4) -> str:
        some, n = self.plain().split(" "), self.rng.randint(1, most)
        at = self.rng.randrange(len(some))
        return " ".join(some[at : at + n]).strip(" .,;:!?-") or "x"

    def number(self) -> str:
        n = self.rng.randint(0, 10 ** self.rng.randint(1, 4))
        return self.of(str(n), str(n), f"{n / 10:.1f}", f"{n:,}")

    def letter(self) -> str:
        return self.rng.choice(string.ascii_letters)

    def name(self) -> str:
        return self.of(self.letter, lambda: self.word().lower(), lambda: f"{self.word().lower()}{self.rng.randint(0, 99)}", lambda: f"{self.word().lower()}_{self.letter()}", lambda: f"{self.word().lower()}{self.word().title()}")

    def url(self) -> str:
        return self.of("http://", "https://", "https://www.", "//") + self.word().lower() + self.of(".org", ".example", ".com", ".net") + self.of("", "/", f"/{self.name()}/{self.number()}", f"/{self.word()}_{self.number()}?q={self.name()}&p={self.number()}#{self.name()}")

    def attributes(self) -> str:
        quote = self.of('"', '"', "'", "")
        return "".join(f" {self.rng.choice(ATTRIBUTES)}={quote}{self.of(self.name, self.number, self.url, lambda: f'color:#{self.rng.randint(100, 999)}')}{quote}" for _ in range(self.rng.choice([0, 0, 1, 1, 2, 3])))

    def tag(self, names: list[str]) -> tuple[str, str]:
        name = self.rng.choice(names)
        name = name.upper() if self.rng.random() < 0.1 else name
        return f"<{name}{self.attributes()}>", f"</{name}>"

    # ------------------------------------------------------------ code and formulas

    def code(self) -> str:
        a, b, c, n = self.name(), self.name(), self.name(), self.number()
        return self.of(
            f"{a} = {b}({c}, {n})", f"for {a} in {b}:", f"    return {a} + {n}", f"if ({a} != {b}) {{ {c}(); }}", f"let {a} = [{n}, '{self.words()}'];", f"def {a}({b}, {c}=None):", f'    print("{self.words()}")',
            f"{a}.{b}(x => x.{c})", f"import {a}", f"SELECT {a} FROM {b} WHERE {c} > {n};", f'"{a}": "{self.words()}",', f"while {a}[{n}]: {b} += 1", f"# {self.words()}", f"// {self.words()}", f"$ {a} --{b} {c}", f"{a}: {b}", "}", "    }", f"class {a}:", self.words,
        )

    def symbol(self) -> str:
        return self.of(self.letter, lambda: "\\" + self.rng.choice(GREEK), lambda: f"{self.letter()}_{self.letter()}", lambda: f"{self.letter()}^{self.rng.randint(2, 9)}", lambda: f"{self.letter()}_{{{self.number()}}}", lambda: f"\\{self.of('frac', 'tfrac')}{{{self.letter()}}}{{{self.number()}}}", lambda: f"\\sqrt{{{self.letter()}}}", lambda: f"\\{self.of('sum', 'int', 'prod')}_{{i={self.rng.randint(0, 3)}}}^{{{self.letter()}}} {self.letter()}", self.number)

    def formula(self) -> str:
        parts = [self.of(self.symbol, self.letter)]
        simple = self.rng.random() < 0.35
        for _ in range(self.rng.choice([1, 2, 3, 4, 30])):
            if simple:
                parts += [self.of("=", "+", "-", "<"), self.of(self.letter, self.letter, self.number)]
                continue
            parts += [self.of("=", "+", "-", "<", ">", "\\cdot", "\\leq", "\\approx", "\\to", "\\in"), self.symbol()]
        return " ".join(parts)

    # ------------------------------------------------------------ markup within a line

    def around(self, line: str, left: str, right: str, breaks: bool = True) -> str:
        some = line.split(" ")
        a = self.rng.randrange(len(some))
        b = min(len(some), a + self.rng.randint(1, 6))
        lost = self.rng.random() if breaks else 1
        mid = ("" if lost < 0.1 else left) + " ".join(some[a:b]) + ("" if 0.1 <= lost < 0.2 else right)
        return " ".join(x for x in (" ".join(some[:a]), mid, " ".join(some[b:])) if x)

    def inside(self, line: str, piece: str) -> str:
        some = line.split(" ")
        at = self.rng.randint(0, len(some))
        return (" ".join(some[:at]) + self.of(" ", " ", "") + piece + self.of(" ", " ", "", ",", ".") + " ".join(some[at:])).strip()

    def entity(self) -> str:
        whole = self.of(f"&{self.of(*COMMON, *COMMON, *ENTITIES)};", f"&#{self.rng.randint(33, 9999)};", f"&#x{self.rng.randint(33, 9999):x};", f"&{self.of(*COMMON)};")
        return whole[:-1] if self.rng.random() < 0.08 and "#" not in whole and whole[1:-1] in COMMON else whole

    def template(self) -> str:
        inner = "|".join([self.of(*SPECIAL, self.words), *(self.of(self.words, lambda: f"{self.name()}={self.words()}", self.number, self.url) for _ in range(self.rng.randint(0, 3)))])
        return self.of("{{", "{{", "{{{") + self.of("", inner.title()) + inner + self.of("}}", "}}", "}}", "}}}", "", "}")

    def inline(self, line: str) -> str:
        tex = self.rng.choice(STYLES)
        kind = self.rng.randrange(36)
        if kind < 5:
            return self.around(line, *self.tag(PAIRED))
        return {
            5: lambda: self.inside(line, self.of(f"<!-- {self.words()} -->", f"<!--{self.words()}", f"{self.words()} -->")),
            6: lambda: self.inside(line, self.entity()), 7: lambda: self.inside(line, self.entity()),
            8: lambda: self.inside(line, self.of(f"<{self.of(*ALONE)}>", f"<{self.of(*ALONE)}/>", f"<{self.of(*ALONE)}{self.attributes()} />", f"</{self.of(*PAIRED)}>")),
            9: lambda: self.around(line, "**", "**"), 10: lambda: self.around(line, "*", "*", False), 11: lambda: self.around(line, "***", "***"),
            12: lambda: self.around(line, "`", "`"), 13: lambda: self.around(line, "~~", "~~"), 14: lambda: self.around(line, "__", "__"), 15: lambda: self.around(line, "_", "_", False),
            16: lambda: self.around(line, self.of("[", "!["), f"]({self.url()}{self.of('', ' ' + chr(34) + self.words() + chr(34))}{self.of(')', ')', ')', '')}", False),
            17: lambda: self.around(line, "[", f"][{self.of(self.number, self.name, '')}]", False),
            18: lambda: self.inside(line, f"[^{self.of(self.number, self.name)}]"),
            19: lambda: self.around(line, "[[", "]]"), 20: lambda: self.around(line, f"[[{self.words()}|", "]]"), 21: lambda: self.around(line, f"[[{self.of('File', 'Category', 'Image')}:", "]]"),
            22: lambda: self.around(line, "''", "''"), 23: lambda: self.around(line, "'''", "'''"),
            24: lambda: self.inside(line, self.template()), 25: lambda: self.inside(line, self.template()),
            26: lambda: self.around(line, f"[{self.url()} ", "]", False),
            27: lambda: self.around(line, f"\\{tex}{{", "}", False) if self.rng.random() < 0.9 else self.around(line, f"\\{tex}{{", "", False), 28: lambda: self.around(line, f"\\{tex}{{", "}", False),
            29: lambda: self.around(line, f"\\href{{{self.url()}}}{{", "}", False),
            30: lambda: self.inside(line, self.of("", "", "~") + f"\\{self.rng.choice(BEHIND)}{self.of('', '', f'[{self.number()}]')}{{{self.of(self.name, self.words, self.number)}}}"),
            **dict.fromkeys((31, 34, 35), lambda: self.inside(line, self.of(f"${self.formula()}$", f"${self.symbol()}$", f"\\({self.of('', ' ')}{self.formula()}{self.of('', ' ')}\\)", f"$$ {self.formula()} $$"))),
            32: lambda: self.inside(line, self.of("\\'{e}", '\\"{o}', "\\^i", "na\\\"ive", "\\~n", "\\&", "\\%", "\\_", "\\#", "\\$", "\\ldots", "\\dots{}", "\\LaTeX", "\\textendash", "\\\\", "\\par", "\\noindent", f"{self.word()}~\\ref{{{self.name()}}}", "\\*", "\\[")),
            33: lambda: self.inside(line, f"<ref{self.attributes()}{self.of('/>', f'>{self.words()}</ref>', '>')}") if self.rng.random() < 0.6 else self.inside(line, f"<{self.url()}>"),
        }[kind]()

    # ------------------------------------------------------------ signs in their everyday sense

    def everyday(self) -> str:
        n, m, w, v, x, y = self.number(), self.number(), self.word(), self.word(), self.name(), self.name()
        size = self.rng.randint(12, 120)
        return self.of(
            f"${n}", f"${n} or ${m}", f"US${n}", f"$ {n}", f"{n}$", f"({n}$)", f"${n}m", f"£{n} = ${m}", f"the ${n} {w}", f"${n}-${m}", f"${n}/{w}",
            f"{n} < {m}", f"{w} > {v}", f"{w} < {n}", f"p<{n}", f"{n}>{m}", f">{n}", f"<{n}", f"< {n}", f"{x} >= {n}", f"{x} <= {n}", f"{w} == {v}", f"{x} != {y}", f"{n} = {m}", f"{w} = {v}", f"{x}={n}", f"{n} + {m} = {n}", f"if {x} > {n} then {y}", f"{n} >> {m}", f"{x} && {y}",
            f"{n} * {m}", f"{n} * {m} * {n}", f"{n}*{m}", f"{x} * {n}", f"{w}*", f"{n}*", f"* {w}", f"{w}* and {v}*", f"{self.letter().upper()}*", f"{n}^{m}", f"10^{m}", f"{self.letter()}^2", f"~{n}", f"~ {n}%", f"{n}~{m}", f"~{w}", f"{n}%", f"{w}~",
            f"C:\\{w}\\{v}", f"D:\\{x}\\{y}_{n}.txt", f"{w}\\{v}", f"\\\\{x}\\{y}", f"\\\\{w}\\{y}\\{n}", f"/usr/{x}/{y}", f"~/{x}/{y}.txt", f"%{w.upper()}%", f"{x}/{y}", f"\\{n}", f"either\\or {w}", f"{w} \\ {v}",
            f"{x}_{y}", f"{x}_{y}_{n}", f"{w.upper()}_{v.upper()}", f"{w}_{n}.png", f"{x}_{y}@{w.lower()}.example", f"@{x}_{y}", f"#{n}", f"#{w}", f"No. #{n}", f"#{n} and #{m}", f"{self.letter().upper()}#", f"{w} #{n}", f"# {n}", f"_{n}", f"{w}_",
            f"{w} & {v}", f"{w}&{v}", "R&D", "Q&A", f"{self.letter().upper()}&{self.letter().upper()}", f"{w} & Co.", f"{w} &c.", f"{w}& {v};",
            f"{w} | {v}", f"{w} | {v} | {x}", f"{n}|{m}", f"|{x}|", f"{w} || {v}" if self.rng.random() < 0.2 else f"{w} | {n}", f"{w} > {v} > {x}", f"{w} -> {v}", f"{w} => {v}", f"{w} <- {v}", f"{w} <-> {v}", f"{w} >> {v}", f"{w} -- {v}", f"{w}--{v}", f"{n}--{m}", f"-- {w}", f"{w} ->",
            f"[{w}]", f"[{self.words()}]", f"[{self.words(8)}]", "[...]", "[sic]", f"[{n}]", f"[{n}, {m}]", f"[{n}; {m}]", f"{w}[{n}]", f"[{w}] [{v}]", f"({w} [{v}])", f"[{w}: {v}]", f"[{w}] ({v})", f"{{{w}}}", f"{{{self.words(8)}}}", f"{{{n}, {m}}}", f"({{{w}}})", f"[{{{w}}}]", f"({self.words()})", f"{w}{{{n}}}", f"[{w} {{{v}}}]",
            f"'{w}'", f"'{self.words(8)}'", f'"{self.words(8)}"', f"‘{w}’", f"'{w}', '{v}'", f"'{w} '{v}' {x}'", f"{w}'s", f"{n}'{m}\"", f"rock 'n' {w}",
            "<3", "^_^", ">:(", ":-)", "=)", ":|", "o_O", "T_T", "\\o/", "^^", "¯\\_(ツ)_/¯", ":*", ">_<", "-_-", "=^.^=", "*_*", "</3", "<3 <3", "=]", "}:)",
            f"Ctrl + {self.of('[', ']', '<', '>', '=', '_', '~', '|')}", f"Alt+{self.letter().upper()}", f"the {self.of('<', '>', '=', '*', '#', '&', '|', '~', '^', '_', '$')} key", f"{self.of('<', '>', '=', '*', '#', '&', '|', '~', '^', '_', '$')} means {w}", f"grade {self.of('A', 'B', 'C')}{self.of('+', '-', '*')}",
            "".join(self.rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(size)) + self.of("", "=", "=="), f"{self.rng.getrandbits(64):x}", self.url, self.url, f"{x}({y}) = {n}", f"{w} = {n}{self.of('+', '-', '*', '/')}{m}", f"{n}:{m}", f":{w}:", f"{w}; {v}:", f"f({self.letter()}) = {n}", f"{x}[{n}] = {m}", f"{{{x}}} = {n}",
        )

    def with_everyday(self, line: str) -> str:
        for _ in range(self.rng.randint(1, 4)):
            piece = self.everyday()
            piece = self.of(piece, piece, piece, f"({piece})", f'"{piece}"', f"'{piece}'", f"{piece},", f"{piece}.", f"'{piece}.'", f"{self.words()} {piece} {self.words()}")
            line = self.inside(line, piece)
            line = re.sub(r"^([*#>:;|=~_`-])", r"So \1", line)  # at the start of a line such a sign means something else
        return line

    # ------------------------------------------------------------ blocks

    def block(self) -> list[tuple[str, int, int]]:
        """Lines of one marked block: (line, role, marked)."""
        head, text, lst, code, math, tab, rest = (R[x] for x in ("heading", "text", "list", "code", "formula", "table", "rest"))
        n, title, item, few = self.number(), self.words(), lambda: self.of(self.words, self.words, lambda: self.inline(self.words(5))), self.rng.randint(1, 4)
        fence, bullet, ends = self.of("```", "```", "~~~"), self.of("* ", "** ", "*** ", ": ", ":: ", "; ", "*# "), self.rng.random() < 0.85
        level, space, marks = self.rng.randint(1, 6), self.of("", " "), "=" * self.rng.randint(1, 6)
        env, sec = self.of("equation", "align", "equation*", "gather"), self.of("section", "subsection", "section*", "chapter", "subsubsection", "paragraph")
        one = lambda line, role: [(line, role, 1)]
        got = self.rng.randrange(30)
        return {
            0: lambda: one("#" * level + " " + title + self.of("", " " + "#" * level), head),
            1: lambda: one(marks + space + title + space + marks + self.of("", "", " "), head),
            2: lambda: [(title, text, 0), (self.of("=", "-") * self.rng.randint(3, 40), head, 1)],
            3: lambda: one(f"<h{level}{self.attributes()}>{title}</h{level}>", head),
            4: lambda: one(f"\\{sec}{{{title}}}" + self.of("", f"\\label{{{self.name()}}}", " " + self.plain()), head),
            5: lambda: [(bullet + item(), lst, 1) for _ in range(few)],
            6: lambda: one(self.of("<ul>", "<ol>") + "".join(f"<li>{item()}</li>" for _ in range(few)) + self.of("</ul>", "</ol>", ""), lst),
            7: lambda: [("<ul>", lst, 1), *((f"<li>{item()}" + self.of("</li>", ""), lst, 1) for _ in range(few)), ("</ul>", lst, 1)],
            8: lambda: one("\\begin{itemize} " + " ".join(f"\\item {item()}" for _ in range(few)) + self.of(" \\end{itemize}", ""), lst),
            9: lambda: [("\\begin{enumerate}", lst, 1), *((f"  \\item {item()}", lst, 1) for _ in range(few)), ("\\end{enumerate}", lst, 1)],
            10: lambda: [(f"{self.of('-', '*', '+')} [{self.of(' ', 'x', 'X')}] {item()}", lst, 1) for _ in range(few)],
            11: lambda: [(f"- {self.of('**', '__', '*', '`')}{self.words()}{'' if self.rng.random() < 0.05 else '**'}{self.of(': ', ' ')}{self.words()}", lst, 1) for _ in range(few)],
            12: lambda: [(fence + self.of("", "", self.name), code, 1), *((self.code(), code, 1) for _ in range(few)), *([(fence, code, 1)] if ends else [])],
            13: lambda: [(fence + self.of("", self.name), code, 1), *((self.code(), code, 1) for _ in range(few)), *([(fence, code, 1)] if ends else [])],
            14: lambda: [(self.of("<pre>", "<pre><code>", f"<pre{self.attributes()}>") + self.code(), code, 1), *((self.code(), code, 1) for _ in range(few - 1)), (self.code() + self.of("</pre>", "</code></pre>", ""), code, 1)],
            15: lambda: one(f"\\begin{{verbatim}} {self.code()} " + self.of("\\end{verbatim}", ""), code),
            16: lambda: one(self.of(f"$$ {self.formula()} $$", f"$${self.formula()}$$", f"\\[ {self.formula()} \\]", f"\\begin{{{env}}} {self.formula()} \\end{{{env}}}", f"$$ {self.formula()}"), math),
            17: lambda: [(self.of("$$", "\\["), math, 1), *((self.formula(), math, 1) for _ in range(few)), (self.of("$$", "\\]"), math, 1)],
            18: lambda: [(f"| {self.words()} | {self.words()} |", tab, 1), ("|" + "|".join(self.of(":--", "---", ":-:", " --- ", "------") for _ in range(2)) + "|", tab, 1), *((f"| {item()} | {self.number()} |", tab, 1) for _ in range(few))],
            19: lambda: [("{|" + self.attributes(), tab, 1), (f"! {self.words()} !! {self.words()}", tab, 1), *((line, tab, 1) for _ in range(few) for line in ("|-", f"| {item()} || {self.words()}")), *([("|}", tab, 1)] if ends else [])],
            20: lambda: one(f"<table{self.attributes()}><tr><th>{self.words()}</th></tr><tr><td>{item()}</td></tr></table>", tab),
            21: lambda: [(self.of("> ", ">", ">> ", "> > ") + self.of(self.plain, self.words), text, 1) for _ in range(self.rng.choice([1, 1, 2]))],
            22: lambda: [("{{" + self.of(*SPECIAL).title() + " " + title, rest, 1), *((f"| {self.name()} = {item()}" if self.rng.random() < 0.6 else f"|{self.name()}={item()}", rest, 1) for _ in range(few)), *([("}}", rest, 1)] if ends else [])],
            23: lambda: one(self.of(f"[[{self.of('File', 'Image')}:{self.word()}_{n}.{self.of('png', 'jpg', 'svg')}|{self.of('thumb', 'left', '200px')}|{title}]]", f"[[Category:{title}]]", f"![{title}]({self.url()})", f"![{title}]({self.name()}/{self.word()}_{n}.png)", f"<img{self.attributes()} />", f"[[{self.of('de', 'fr', 'es')}:{title}]]"), rest),
            24: lambda: one(f"[{self.of(self.number, self.name, self.words)}]: {self.url()}" + self.of("", f' "{title}"'), rest),
            25: lambda: one(self.of(self.template, self.template, f"<!-- {title} -->", f"__{self.of('NOTOC', 'TOC', 'NOEDITSECTION', 'FORCETOC')}__", "***", "* * *", "---", "----", "___", "<hr>", f"#REDIRECT [[{title}]]"), rest),
            26: lambda: one(self.of("<p>", "<blockquote>", "<div>", f"<p{self.attributes()}>") + self.plain() + self.of("</p>", "</blockquote>", "</div>", ""), text),
            27: lambda: one(self.of(f"<style>.{self.name()} {{ {self.name()}: {n} }}</style>", f"<script>{self.code()}</script>"), rest),
            28: lambda: [("<div" + self.attributes() + ">", rest, 1), (self.plain(), text, 0), ("</div>", rest, 1)],
            29: lambda: [(self.of("\\begin{quote}", "\\begin{center}"), rest, 1), (self.plain(), text, 0), (self.of("\\end{quote}", "\\end{center}"), rest, 1)],
        }[got]()

    def text(self) -> tuple[str, list[tuple[int, int]]]:
        """A text, and (role, marked) of its leaves."""
        rng, lines, labels = self.rng, [], []
        if rng.random() < 0.8:
            lines.append(f"[{self.words(3)}{self.of('', '', f' ({self.word()}-{self.number()})', f' ({self.words(2)})')}]" + self.of("", f" — {self.words(3)}", f" — {self.words(2)}, {self.words(2)}"))
            labels.append((R["text"], 0))
        dirt, daily = rng.choice([0.0, 0.0, 0.1, 0.3, 0.6]), rng.choice([0.0, 0.15, 0.4])
        for _ in range(rng.randint(1, 10)):
            if rng.random() < dirt * 0.5:
                for line, role, marked in self.block():
                    lines.append(line)
                    labels.append((role, marked))
            else:
                line, marked = self.plain(), 0
                if rng.random() < 0.08:
                    line = self.of(f"- {self.words()}: {self.words(5)}", f"- {self.words()} ({self.number()})", f"[{self.words()}]", self.words(), f"{self.words()}: {self.words()}", f"{self.number()}. {self.words()}", f"-{self.words()}", f"— {self.words()}")
                role = R["list"] if line.startswith("- ") else R["text"]
                if rng.random() < daily:
                    line = self.of(lambda line=line: self.with_everyday(line), lambda line=line: self.with_everyday(line), lambda: self.with_everyday(self.words(3)))
                    role = R["text"] if not line.startswith("- ") else role
                if rng.random() < dirt and len(line.split(" ")) > 1:
                    for _ in range(self.of(1, 1, 1, 2)):
                        line = self.inline(line)
                    marked = 1
                lines.append(line)
                labels.append((role, marked))
            if rng.random() < 0.4:
                lines.append("")
        return "\n".join(lines), labels


COMMON = ("nbsp", "amp", "lt", "gt", "quot", "mdash", "ndash", "hellip", "rsquo", "lsquo", "ldquo", "rdquo", "copy", "eacute")
ENTITIES = tuple(sorted(name2codepoint))


def _init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size, n = HIDDEN, M.WIDTH
    w = {}
    for way in "fb":
        w[f"w{way}"] = rng.normal(0, 1 / n**0.5, (n, 4 * size))
        w[f"u{way}"] = rng.normal(0, 1 / size**0.5, (size, 4 * size))
        w[f"v{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], size)
    w["out"] = rng.normal(0, 0.1, (2 * size, len(ROLES) + 1))
    w["bias"] = np.zeros(len(ROLES) + 1)
    w["words"] = rng.normal(0, 0.1, (M.WORDS, M.DIM))
    w["paths"] = rng.normal(0, 0.1, (M.PATHS, M.DIM))
    w["inner"] = rng.normal(0, 0.1, (M.PATHS, M.DIM))
    w["grams"] = np.zeros((M.GRAMS, M.SIGN_DIM))  # an n-gram that was never met says nothing
    return {k: v.astype(np.float32) for k, v in w.items()}


def _forward(w, u, b, x):
    steps, n, _ = x.shape
    size = u.shape[0]
    h = np.zeros((steps + 1, n, size), np.float32)
    c = np.zeros_like(h)
    gates = np.zeros((steps, n, 4 * size), np.float32)
    z_all = x @ w + b
    for t in range(steps):
        z = z_all[t] + h[t] @ u
        g = np.concatenate([M.sigmoid(z[:, : 3 * size]), np.tanh(z[:, 3 * size :])], axis=1)
        c[t + 1] = g[:, size : 2 * size] * c[t] + g[:, :size] * g[:, 3 * size :]
        h[t + 1] = g[:, 2 * size : 3 * size] * np.tanh(c[t + 1])
        gates[t] = g
    return h, c, gates


def _backward(w, u, x, h, c, gates, dh_out):
    steps, n, _ = x.shape
    size = u.shape[0]
    dz_all = np.zeros_like(gates)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * size : (k + 1) * size] for k in range(4))
        tc = np.tanh(c[t + 1])
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        dh, dc = dz @ u.T, dc * f
    flat = dz_all.reshape(-1, 4 * size)
    return x.reshape(-1, x.shape[2]).T @ flat, h[:-1].reshape(-1, size).T @ flat, flat.sum(0), (flat @ w.T).reshape(x.shape)


def train(texts: list[tuple[str, list[tuple[int, int]]]], epochs: int = 10, batch: int = 64, seed: int = 3, rate: float = 0.005, drop: float = 0.2) -> dict[str, np.ndarray]:
    """The weights. In each step a part of the n-grams is hidden, so that no single one is relied on."""
    rng = np.random.default_rng(seed)
    weights = _init(rng)
    first, second, step_no = {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}, 0
    items = [(found, labels) for text, labels in texts if len(found := M.leaves(text)) == len(labels)]
    print(len(items), "texts of", len(texts))
    batches = []
    order = rng.permutation(len(items))
    for begin in range(0, len(order), batch):
        part = [items[k] for k in order[begin : begin + batch]]
        flat = [leaf for found, _ in part for leaf in found]
        role = np.array([r for _, labels in part for r, _ in labels])
        marked = np.array([m for _, labels in part for _, m in labels], np.float32)
        batches.append((M.Described(flat), np.array([len(found) for found, _ in part]), role, marked))
    for epoch in range(epochs):
        loss_sum, right, total = 0.0, np.zeros(2), 0
        for k in rng.permutation(len(batches)):
            read, lengths, role, marked = batches[k]
            n = len(role)
            shown = rng.random(read.grams.shape) >= drop
            raw = np.zeros((len(read.grams), M.SIGN_DIM), np.float32)
            for i in range(read.grams.shape[1]):
                raw += weights["grams"][read.grams[:, i]] * shown[:, i, None]
            vectors = np.tanh(raw)
            signs = M.pooled(read.owner, vectors, n)
            count = np.maximum(read.count, 1).astype(np.float32)
            words = np.zeros((n, M.DIM), np.float32)
            owner = np.repeat(np.arange(n), read.count)
            np.add.at(words, owner, weights["words"][read.words])
            words /= count[:, None]
            x = np.concatenate([read.figures, weights["paths"][read.path], weights["inner"][read.inner], words, signs], axis=1)
            step, seq, back, _ = M.padded(lengths)
            grids, caches = [], []
            for way, at in (("f", step), ("b", back)):
                grid = np.zeros((lengths.max(), len(lengths), x.shape[1]), np.float32)
                grid[at, seq] = x
                grids.append(grid)
                caches.append(_forward(weights[f"w{way}"], weights[f"u{way}"], weights[f"v{way}"], grid))
            hidden = np.concatenate([caches[0][0][1:][step, seq], caches[1][0][1:][back, seq]], axis=1)
            out = hidden @ weights["out"] + weights["bias"]
            p = np.exp(out[:, :-1] - out[:, :-1].max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            q = M.sigmoid(out[:, -1])
            loss_sum += float(-np.log(p[np.arange(n), role] + 1e-9).sum() - np.log(np.where(marked > 0, q, 1 - q) + 1e-9).sum())
            right += [(p.argmax(1) == role).sum(), ((q > 0.5) == (marked > 0)).sum()]
            total += n
            d = np.concatenate([p, (q - marked)[:, None] * 3], axis=1)
            d[np.arange(n), role] -= 1
            d = (d / n).astype(np.float32)
            grad = {"out": hidden.T @ d, "bias": d.sum(0)}
            dh, dx = d @ weights["out"].T, np.zeros_like(x)
            for k, (way, at) in enumerate((("f", step), ("b", back))):
                out_grid = np.zeros((*grids[k].shape[:2], HIDDEN), np.float32)
                out_grid[at, seq] = dh[:, k * HIDDEN : (k + 1) * HIDDEN]
                grad[f"w{way}"], grad[f"u{way}"], grad[f"v{way}"], dgrid = _backward(weights[f"w{way}"], weights[f"u{way}"], grids[k], *caches[k], out_grid)
                dx += dgrid[at, seq]
            cuts = np.cumsum([M.FIGURES, M.DIM, M.DIM, M.DIM])
            _, d_path, d_inner, d_words, d_signs = np.split(dx, cuts, axis=1)
            for name, ids, part in (("paths", read.path, d_path), ("inner", read.inner, d_inner), ("words", read.words, (d_words / count[:, None])[owner])):
                grad[name] = np.zeros_like(weights[name])
                np.add.at(grad[name], ids, part)
            top = vectors == signs[read.owner]
            d_raw = d_signs[read.owner] * top * (1 - vectors * vectors)
            grad["grams"] = np.zeros_like(weights["grams"])
            for i in range(read.grams.shape[1]):
                np.add.at(grad["grams"], read.grams[:, i], d_raw * shown[:, i, None])
            step_no += 1
            pace = rate * (0.5 ** max(0, epoch - 4))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= pace * (first[k] / (1 - 0.9**step_no)) / (np.sqrt(second[k] / (1 - 0.999**step_no)) + 1e-8)
        print(f"epoch {epoch}: loss {loss_sum / total:.4f}, roles {right[0] / total:.4f}, marks {right[1] / total:.4f}", flush=True)
    weights["grams"] *= 1 - drop
    return weights


def plain_lines(path: str, most: int = PLAIN_LINES, seed: int = 5) -> list[str]:
    """A bounded, seeded sample of the lines of a chunk table that hold none of the signs of ``BARE``."""
    import pyarrow.parquet as pq

    lines = {line for text in pq.read_table(path, columns=["text"])["text"].to_pylist() if text for line in text.split("\n")[1:] if len(line.strip()) > 10 and not BARE.search(line)}
    return random.Random(seed).sample(sorted(lines), min(most, len(lines)))


def main(source: str, target: str) -> None:
    maker = Maker(17, plain_lines(source))
    weights = train([maker.text() for _ in range(TEXTS)])
    np.savez_compressed(target, **{k: v.astype(np.float16) for k, v in weights.items()})


if __name__ == "__main__":
    main(*sys.argv[1:])
