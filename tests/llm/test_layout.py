"""The renderer against a plain one of its own, on random small pages, and the size of what it emits."""

import random
import re

import pytest

from plainsight.llm.render import HiddenBy, Tree, rendered


class Plain:
    """Lines of pages made of a few tags, by recursion over nested lists; no markup is repaired."""

    def __init__(self, page):
        self.page = page

    def html(self, x):
        if isinstance(x, str):
            return x
        tag, children = x
        if tag == "hidden":
            return "<p hidden>" + "".join(map(self.html, children)) + "</p>"
        return f"<{tag}>" + "".join(map(self.html, children)) + f"</{tag}>"

    def lines(self, children, ordered=False):
        """(lines, whether the last block asks for a gap)"""
        out, inline, gap, number = [], "", False, 1

        def add(new, spaced):
            nonlocal gap
            if new:
                if out and (spaced or gap) and out[-1].strip():
                    out.append("")
                out.extend(new)
                gap = spaced

        for x in [*children, None]:
            if isinstance(x, str) or (x and x[0] == "b"):
                inline += x if isinstance(x, str) else "".join(x[1])
                continue
            if x and x[0] == "hidden":
                continue
            text = re.sub(r"\s+", " ", inline).strip(" ")
            inline = ""
            if text:
                add([text], False)
            if x is None:
                continue
            tag, own = x
            if tag == "li":
                mark = f"{number}. " if ordered else "- "
                number += 1
                new = self.lines(own) or [""]
                add([mark + new[0]] + [" " * len(mark) + y if y.strip() else y for y in new[1:]], False)
            elif tag == "table":
                add(self.table(own), True)
            else:
                add(self.lines(own, tag == "ol"), tag != "div")
        return out

    def table(self, rows):
        cells = [[self.lines(cell) for _, cell in row] for _, row in rows]
        width = {}
        for row in cells:
            for c, own in enumerate(row):
                if own:
                    width[c] = max([width.get(c, 0), *(len(y) for y in own if len(y) <= 60)])
        start, at = {}, 0
        for c in sorted(width):
            if at <= 240:
                start[c] = at
            at += width[c] + 2
        out = []
        for row in cells:
            for i in range(max(map(len, row), default=0)):
                line = ""
                for c, own in enumerate(row):
                    if i < len(own) and own[i]:
                        line += " " * max(start.get(c, 0) - len(line), 2 if line else 0) + own[i]
                out.append(line.rstrip())
        return out

    def text(self):
        out = self.lines(self.page)
        while out and not out[0].strip():
            out.pop(0)
        while out and not out[-1].strip():
            out.pop()
        return "\n".join(out)


def random_page(rng, depth=3, in_cell=False):
    def words():
        return " ".join(rng.choice(["a", "bb", "ccc", "x" * 30, "y" * 70, "é"]) for _ in range(rng.randrange(1, 4)))

    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["text", "b", "div", "p", "ul", "ol", "table", "hidden"])
        if kind == "text" or depth == 0:
            out.append(" " + words() + " ")
        elif kind in ("b", "p", "hidden"):
            out.append((kind, [words()]))
        elif kind == "div":
            out.append((kind, random_page(rng, depth - 1, in_cell)))
        elif kind in ("ul", "ol"):
            out.append((kind, [("li", [words()]) for _ in range(rng.randrange(1, 12))]))
        elif not in_cell:
            columns = rng.randrange(1, 9)
            out.append((kind, [("tr", [("td", random_page(rng, 1, True) if rng.random() < 0.8 else []) for _ in range(columns)]) for _ in range(rng.randrange(1, 5))]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_pages_equal_a_plain_renderer(seed):
    rng = random.Random(seed)
    for _ in range(150):
        page = Plain(random_page(rng))
        html = "".join(map(page.html, page.page))
        assert rendered(html)[0] == page.text(), html


def test_white_space_is_bounded():
    wide = "<table><tr><td>" + "x" * 40_000 + "<td>b" + "<tr><td>a<td>b" * 3000 + "</table>"
    text = rendered(wide)[0]
    assert len(text) < len(wide) and text.splitlines()[0] == "x" * 40_000 + "  b" and text.splitlines()[1] == "a  b"
    spans = "<table><tr>" + ("<td>" + "y" * 60) * 1000 + "<tr><td colspan=999><td>x" * 2000
    assert len(rendered(spans)[0]) < 250 * 2001 + len(spans)
    nested = "<table><td>" + "n" * 50 + "<td>"
    assert max(map(len, rendered(nested * 100 + "x<br>" * 50)[0].splitlines())) < 100 * 52 + 240 * 6


def test_rules_are_found_by_their_names():
    rng = random.Random(4)
    rules, names = [], "abcd"
    for _ in range(60):
        tag, own = rng.choice(["", "p", "div"]), "".join(rng.choice(["." + rng.choice(names), "#" + rng.choice(names)]) for _ in range(rng.randrange(3)))
        rules.append(tag + own)
    for _ in range(300):
        chosen = [r for r in rng.sample(rules, 3) if r]
        hides = HiddenBy("".join(f"{r}{{display:none}}" for r in chosen))
        tag, classes, own = rng.choice(["p", "div", "b"]), {rng.choice(names) for _ in range(rng.randrange(3))}, rng.choice([*names, None])
        attributes = (f' class="{" ".join(classes)}"' if classes else "") + (f" id={own}" if own else "")
        node = Tree(f"<{tag}{attributes}>").root.children[0]

        def matches(rule):
            t, parts = re.match(r"([a-z]*)(.*)", rule).groups()
            parts = re.findall(r"[.#]\w+", parts)
            return t in ("", tag) and all(p[1:] in classes if p[0] == "." else p[1:] == own for p in parts)

        assert hides(node) == any(matches(r) for r in chosen)
