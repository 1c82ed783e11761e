"""Rewriting of markup lines as clean text: the signs of HTML, Markdown, wiki and LaTeX markup, and what is kept of them.

Which lines carry markup, and which role a line has, the labeller of ``markup`` decides; the
scanner here only says where in such a line the signs stand.
"""

from __future__ import annotations

import html
import re

ROLES = ("text", "heading", "list", "code", "formula", "table", "rest")

_TAGS = (
    "a|abbr|b|big|blockquote|body|br|caption|center|cite|code|dd|del|div|dl|dt|em|figcaption|figure|font|h[1-6]|head|hr|html|i|iframe|img|ins|"
    "kbd|li|link|math|meta|nowiki|ol|p|pre|q|ref|s|script|section|small|span|strike|strong|style|sub|sup|table|tbody|td|th|thead|title|tr|tt|u|ul|video"
)

#: Kinds of signs; where several match at a place, the first does.
_KINDS = {
    "comment": r"<!--.*?(?:-->|$)|(?<=--)>",
    "autolink": r"<(?:https?://|mailto:)[^>\s]*>?",
    "tag": r"</?[A-Za-z][A-Za-z0-9:-]*(?:[\s/][^<>]*)?>",
    "tag_cut": rf"</?(?i:{_TAGS})\b[^<>]*$",
    "charref": r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});|&(?:nbsp|amp|lt|gt|quot|[mn]dash|hellip|[lr][sd]quo|apos|#\d{2,6})(?![A-Za-z;=])",
    "environment": r"\\(?:begin|end)\s*\{[^}\n]*\}?",
    "display": r"\$\$|(?<!\\)\\[\[\]()]",
    "inline": r"\$(?=[^$\n]*[\\^_{])[^$\n]+\$|\$(?=[A-Za-z(\\])[^$\n]+\$(?!\d)",
    "fence": r"^(?:```|~~~)[^`]*$",
    "code": r"`{1,2}[^`\n]+`{1,2}|`",
    "definition": r"^\[[^\]\n]+\]:\s*\S+",
    "link": r"\[[^\[\]\n]*\]\([^()\n]*(?:\)|$)",
    "reference": r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]|\[\^[^\]\n]+\]",
    "wikilink": r"\[\[|\]\]",
    "extlink": r"\[(?:https?:)?//\S+",
    "task": r"(?<=[-*+] )\[[ xX]\](?=\s)",
    "template": r"\{\{+|\}\}+",
    "wiki_table": r"^\{\||^\|\}|^\|[-+](?=\s|$)",
    "table_rule": r"^\|\s*:?-{2,}:?\s*\|[\s:|-]*$",
    "table_row": r"^\|[^\n]*\|\s*$",
    "parameter": r"^\|\s*[\w ]+=",
    "cell": r"^[|!](?=\s?\w)|\|\|",
    "wiki_heading": r"^={1,6}(?=[^=\n])[^\n]*?[^=\n]={1,6}\s*$",
    "underline": r"^={3,}\s*$|^-{3,}\s*$",
    "rule": r"^(?:\*[ \t]?){3,}\s*$|^_{3,}\s*$",
    "quotes": r"''+",
    "heading": r"^#{1,6}\s+(?=\S)",
    "wiki_list": r"^[*:;]{1,6}\s+(?=\S)|^[*#:;]{2,6}\s*(?=\S)",
    "quote": r"^>",
    "strong": r"\*{2,3}(?=\S)|(?<=\S)\*{2,3}",
    "emphasis": r"(?<![\w*])\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?![\w*])",
    "magic": r"__[A-Z]{3,}__",
    "under": r"(?<!\w)__(?=[^\s_])|(?<=[^\s_])__(?!\w)|(?<!\w)_(?=[A-Za-z])[^_\n]*(?<=[^\W_])_(?!\w)",
    "strike": r"~~(?!~)",
    "path": r"(?<=[A-Za-z]:)\\[^\s\\]*(?:\\[^\s\\]*)*|(?<![\\\w])\\\\\w[\w.-]*\\[\w\\.-]*",
    "accent": r"""\\['"`^~=.](?:\{\w+\}|\\?[A-Za-z])""",
    "command": r"\\[A-Za-z]+\*?",
    "escape": r"\\[%&$#_{}~*`>+.!|\[\]-]|\\\\",
    "tie": r"(?<=\w)~(?=[A-Z\\])",
    "money": r"\$(?=\s?\d)",
    "compare": r"<(?=[\s\d=-]|$)|(?<=\s)>(?=\s)|[<>]=",
    "and": r"&",
    "star": r"\*",
    "bracket": r"\[[^\[\]\n]*\]?|\]",
    "brace": r"\{[^{}\n]*\}?|\}",
    "tilde": r"~",
    "caret": r"\^",
    "pipe": r"\|",
    "underscore": r"_",
    "equal": r"=",
    "other": r"[<>$\\]",
}
_SCAN = re.compile(r"(?=[<>&$\\`\[\]{}|=*_~^']|^[-#!:;])(?:" + "|".join(f"(?P<{n}>{p})" for n, p in _KINDS.items()) + ")")
_SPECIAL = re.compile(r"[<>&$\\`\[\]{}|=*_~^]|''|^(?:[#!:;]|-{3,})")


def scan(line: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the signs of a line, from left to right; spaces before it don't count."""
    if not _SPECIAL.search(line):
        return []
    shift = len(line) - len(line.lstrip())
    return [(m.lastgroup, m.start() + shift, m.end() + shift) for m in _SCAN.finditer(line[shift:])]


_DROP = frozenset(("comment", "tag", "tag_cut", "wikilink", "strong", "quotes", "under", "strike", "template", "environment", "display", "magic", "rule", "wiki_table", "table_rule", "underline", "fence", "task"))
_GLYPHS = {"ldots": "…", "dots": "…", "textendash": "–", "textemdash": "—", "item": "\n- ", "textbackslash": "\\", "par": "\n"}
#: Commands whose arguments are no text of the sentence, and elements that are left out whole.
_ASIDES = frozenset(("cite", "citep", "citet", "label", "ref", "pageref", "index", "marginpar", "footnote", "includegraphics", "vspace", "hspace", "usepackage", "documentclass"))
_ELEMENTS = re.compile(r"<(ref|style|script)\b[^<>]*>.*?</\1>|<sup\s[^<>]*\bref[^<>]*>.*?</sup>|<ref\b[^<>]*/>", re.I)
_ASIDE = re.compile("\2(?:\\[[^\\]]*\\])?(?:\\{[^{}]*\\})*")
_MARKS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
_LAST = re.compile("\1(?:\\[[^\\]]*\\])?(?:\\{[^{}]*\\}(?=\\{))*\\{([^{}]*)\\}")


def _plain(line: str, signs: list[tuple[str, int, int]]) -> str:
    """A line without its markup signs; what they hold stays."""
    out, at = [], 0
    for kind, start, end in signs:
        if start < at:
            continue
        out.append(line[at:start])
        sign, at = line[start:end], end
        if kind == "tag" and re.match(r"<(?:br|li|/?p|/?tr|/?h\d)\b", sign, re.I):
            out.append("\n- " if sign[:3].lower() == "<li" else "\n")
        elif kind == "tag" and re.match(r"</?t[dh]\b", sign, re.I):
            out.append(" ")
        elif kind == "charref":
            out.append(html.unescape(sign if sign.endswith(";") else sign + ";"))
        elif kind == "autolink":
            out.append(sign.strip("<>"))
        elif kind == "inline":
            out.append(sign.strip("$"))
        elif kind == "code":
            out.append(sign.strip("`"))
        elif kind == "link":
            if out and out[-1].endswith("!"):
                out[-1] = out[-1][:-1]
            out.append(sign[1 : sign.index("]")])
        elif kind == "reference":
            out.append("" if sign.startswith("[^") else sign[1 : sign.index("]")])
        elif kind == "extlink":
            close = line.find("]", at)
            if close >= 0:
                line = line[:close] + "\0" + line[close + 1 :]
        elif kind in ("heading", "wiki_heading"):
            out.append(sign.strip("#= \t") if kind == "wiki_heading" else "")
        elif kind == "wiki_list":
            out.append("- ")
        elif kind == "quote":
            pass
        elif kind == "emphasis":
            out.append(sign.strip("*"))
        elif kind in ("parameter", "cell", "table_row"):
            out.append(" ".join(x.strip() for x in sign.split("|") if x.strip()) if kind == "table_row" else sign.strip("|!= ") + (": " if kind == "parameter" else " "))
        elif kind == "accent":
            letter = re.sub(r"[\\{}]", "", sign[2:])
            out.append(letter + _MARKS[sign[1]])
        elif kind == "command":
            name = sign[1:].rstrip("*")
            out.append("\2" if name in _ASIDES else _GLYPHS.get(name, "\1"))
        elif kind == "escape":
            out.append(sign[1:] if sign != "\\\\" else "\n")
        elif kind == "tie":
            out.append(" ")
        elif kind == "definition" or kind in _DROP:
            pass
        else:
            out.append(sign)
    text = "".join([*out, line[at:]]).replace("\0", "")
    text = _ASIDE.sub("", text) if "\2" in text else text
    while "\1" in text:  # a command keeps what its last argument says
        text, again = _LAST.sub(r"\1", text, count=1), text
        if text == again:
            text = text.replace("\1", "", 1)
    text = re.sub(r"(?<=\[)[^\[\]]*\|", "", text) if "[[" in text else text
    return text


_TARGET = re.compile(r"\[\[(?:(?i:file|image|category):[^\]\n]*\]\]|[^\[\]|\n]*\|(?=[^\[\]\n]*\]\]))")


def clean(found: list, roles, marked) -> list[tuple[str, str, int]]:
    """(role, text, line number) of the leaves of a text, those that are ``marked`` without their markup.

    Code keeps its lines as they stand and formulas their source, both without the signs around them.
    """
    out = []
    for leaf, role, dirty in zip(found, roles, marked, strict=True):
        name, line = ROLES[role], leaf.line
        if not dirty:
            out.append((name if name in ("list", "heading") else "text", line, leaf.number))
            continue
        signs = scan(line)
        kinds = {k for k, _, _ in signs}
        if "```" in leaf.inside or "pre" in leaf.inside:
            name = "code"
        if "```" in leaf.inside and "fence" not in kinds:
            out.append((name, line, leaf.number))
        elif ("display" in kinds or "math" in leaf.inside) and name == "formula":
            out.append((name, re.sub(r"\$\$|\\[\[\]]", "", line).strip(), leaf.number))
        else:
            kept = _ELEMENTS.sub(" ", line) if "tag" in kinds else line
            kept = _TARGET.sub(lambda m: "" if m[0].endswith("]]") else "[[", kept) if "wikilink" in kinds else kept
            plain = _plain(kept, signs if kept is line else scan(kept))
            for part in plain.split("\n"):
                if part.strip():
                    kind = "list" if part.lstrip().startswith("- ") else name
                    out.append((kind, part.rstrip() if kind == "code" else re.sub(r"[ \t]+", " ", part).strip(), leaf.number))
    return out


def joined(blocks: list[tuple[str, str, int]]) -> str:
    """The blocks as a text; where blank lines stood between them, one stands."""
    out, last = [], None
    for _, text, number in blocks:
        out.append(("" if last is None else "\n\n" if number > last + 1 else "\n") + text)
        last = number
    return "".join(out)
