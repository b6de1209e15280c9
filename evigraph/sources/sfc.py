"""Single-file components: blocks, scripts as child units, component tags and style references."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .modules import Facts, NotPlaced, Tag, Use, module_facts

_TAG = re.compile(r"<(/?)([A-Za-z][\w.:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*?)(/?)>|<!--.*?-->", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Tags of a template that are no components.
BUILT_IN = set("component transition transition-group keep-alive slot teleport suspense template".split())
NATIVE = set("""a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup data
datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html i
iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p picture pre
progress q rp rt ruby s samp script section select small source span strong style sub summary sup svg table tbody td textarea tfoot th thead
time title tr track u ul var video wbr path circle rect line g defs use text ellipse polygon polyline""".split())


@dataclass(frozen=True)
class Block:
    tag: str
    attributes: dict
    start: int
    end: int


def blocks(text: str) -> list[Block]:
    """The top-level blocks, with the span of their content. Script and style end at their first end tag, others nest."""
    out, at = [], 0
    while m := _TAG.search(text, at):
        at = m.end()
        if m[0].startswith("<!--"):
            continue
        if m[1]:
            raise NotPlaced(f"end tag without a block at {m.start()}")
        attributes = {a[0]: next((x for x in a[1:] if x), "") for a in _ATTRIBUTE.findall(m[3])}
        if m[4]:
            out.append(Block(m[2].lower(), attributes, at, at))
            continue
        depth, k = 1, at
        raw = m[2].lower() in ("script", "style")
        while depth:
            n = re.compile(rf"<(/?){re.escape(m[2])}\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*?(/?)>", re.I).search(text, k)
            if n is None:
                raise NotPlaced(f"{m[2]} does not end")
            depth += -1 if n[1] else 0 if n[2] or raw else 1
            k = n.end()
        out.append(Block(m[2].lower(), attributes, at, n.start()))
        at = k
    return out


def binding_name(tag: str) -> str:
    """my-card and MyCard are one component."""
    return "".join(x[:1].upper() + x[1:] for x in tag.split("-"))


def template_tags(template: str) -> list[Tag]:
    """The components that a template uses, each tag where it begins. A static one stands for the script's binding of its
    name; one chosen at run time or below a namespace has no such name."""
    found = []
    for m in _TAG.finditer(template):
        tag = m[2]
        if m[0].startswith("<!--") or m[1]:
            continue
        if tag.lower() == "component":
            if re.search(r"(?:^|\s)(?::is|v-bind:is)\s*=", m[3]):
                found.append(Tag(tag, "", "dynamic", m.start(), m.end()))
        elif "." in tag:
            found.append(Tag(tag, tag.partition(".")[0], "namespace", m.start(), m.end()))
        elif tag.lower() not in BUILT_IN and not (tag.islower() and tag in NATIVE):
            found.append(Tag(tag, binding_name(tag), "static", m.start(), m.end()))
    return found


def component_tags(template: str) -> tuple[list[str], bool]:
    """(component names used in a template, whether one is chosen at run time)."""
    found = template_tags(template)
    return sorted({t.binding for t in found if t.binding}), any(t.kind == "dynamic" for t in found)


def style_references(css: str) -> list[str]:
    """Relative @import and url() targets; comments are skipped."""
    css = re.sub(r"/\*.*?\*/", " ", css, flags=re.S)
    found = re.findall(r"@import\s+(?:url\(\s*)?[\"']?([^\"')\s;]+)|url\(\s*[\"']?([^\"')\s]+)", css)
    return sorted({x for pair in found for x in pair if x.startswith(("./", "../"))})


def component_facts(data: bytes) -> Facts:
    """Uses of a component file: its scripts' own, shifted to the file, an external script, and style references, and the tags
    of its template. Spans count bytes. It has no named exports. Anything unreadable makes the whole file unknown."""
    try:
        text = data.decode("utf-8")
        found = blocks(text)
    except UnicodeDecodeError:
        return Facts(unknown=["source is not UTF-8"])
    except NotPlaced as e:
        return Facts(unknown=[f"component does not decompose: {e}"])
    scripts = [b for b in found if b.tag == "script"]
    if len(scripts) > 2 or sum("setup" in b.attributes for b in scripts) > 1 or sum(b.tag == "template" for b in found) > 1:
        return Facts(unknown=["component has more blocks of a kind than its format allows"])
    out = Facts()
    for b in found:
        start, end = (len(text[:k].encode()) for k in (b.start, b.end))
        inside = text[b.start : b.end]
        shifted = lambda xs, by=start: [replace(x, start=x.start + by, end=x.end + by) for x in xs]
        if b.tag == "script" and "src" in b.attributes:
            out.uses.append(Use(b.attributes["src"], None, None, "value", "namespace", "static-import", start, end))
        elif b.tag == "script":
            own = module_facts(inside.encode(), b.attributes.get("lang", "js"))
            out.unknown += own.unknown
            out.uses += shifted(own.uses)
        elif b.tag == "style":
            out.uses += [Use(x, None, None, "value", "side-effect", "static-import", start, end) for x in style_references(inside)]
        elif b.tag == "template" and "src" in b.attributes:
            out.unknown.append("template is in another file")
        elif b.tag == "template":
            out.tags += shifted(Facts(tags=template_tags(inside)).in_bytes(inside).tags)
    return out.ordered()
