"""Parsers of the command language: geometry, channel lists, frame ranges, options. Plain Python, without Spark."""

from __future__ import annotations

import re

from lumenframe.core import Roi

_NUMBER = r"[+-]?\d+"


def parse_geometry(text: str, within: Roi | None = None) -> Roi:
    """WxH, WxH+X+Y, x0,y0,x1,y1 (inclusive), or P%, PxQ% and 0xH sizes relative to `within`."""
    if m := re.fullmatch(rf"({_NUMBER}),({_NUMBER}),({_NUMBER}),({_NUMBER})", text):
        x0, y0, x1, y1 = map(int, m.groups())
        return Roi(x0, x1 + 1, y0, y1 + 1)
    if m := re.fullmatch(r"([\d.]+)%(?:x([\d.]+)%)?", text):
        if within is None:
            raise ValueError(f"{text!r} needs an image")
        p, q = float(m[1]), float(m[2] or m[1])
        return Roi(0, int(within.width * p / 100 + 0.5), 0, int(within.height * q / 100 + 0.5))
    if m := re.fullmatch(rf"(\d+)x(\d+)(?:([+-]\d+)([+-]\d+))?", text):
        w, h, x, y = int(m[1]), int(m[2]), int(m[3] or 0), int(m[4] or 0)
        if within is not None and (w == 0) != (h == 0):  # keeps the aspect
            w, h = (int(h * within.width / within.height + 0.5), h) if w == 0 else (w, int(w * within.height / within.width + 0.5))
        return Roi(x, x + w, y, y + h)
    if m := re.fullmatch(r"([+-]\d+)([+-]\d+)", text):
        size = within or Roi(0, 0, 0, 0)
        return size.shifted(int(m[1]) - size.x0, int(m[2]) - size.y0)
    raise ValueError(f"not a geometry: {text!r}")


def parse_channels(text: str, names: tuple[str, ...]) -> tuple[list[int], list[float], list[str]]:
    """Order, values and names of a list such as R,2,new=G,A=1.0,=0.5; an unknown channel is zero."""
    order, values, out = [], [], []
    lower = [n.lower() for n in names]
    for k, part in enumerate(text.split(",")):
        new, eq, old = part.rpartition("=")
        index, value = -1, 0.0
        if re.fullmatch(r"\d+", old) and not eq and int(old) < len(names):
            index = int(old)
        elif old in names:
            index = names.index(old)
        elif old.lower() in lower:
            index = lower.index(old.lower())
        elif re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", old) and eq:
            value = float(old)
        order.append(index)
        values.append(value)
        out.append(new or (names[index] if index >= 0 else f"channel{k}" if eq else old))
    return order, values, out


def parse_frames(text: str) -> list[int]:
    """1-10x2 counts by two, 1-10y2 has what that leaves out; parts are joined by commas, once each."""
    out: list[int] = []
    for part in text.split(","):
        m = re.fullmatch(r"(-?\d+)(?:-(-?\d+)(?:([xy])(-?\d+))?)?", part.strip())
        if not m:
            raise ValueError(f"not a frame range: {text!r}")
        first, last, step = int(m[1]), int(m[2] or m[1]), int(m[4] or 1)
        whole = list(range(first, last + (1 if last >= first else -1), 1 if last >= first else -1))
        every = set(whole[:: max(1, abs(step))])
        out += [f for f in whole if (f in every) != (m[3] == "y")]
    return list(dict.fromkeys(out))


def expand_frames(pattern: str, frames: list[int], padding: int = 4, views: tuple[str, ...] = ("",)) -> list[str]:
    """File names: # is four digits, @ one, %04d as in printf, %V and %v a view and its first letter."""
    out = []
    for view in views:
        for f in frames:
            s = re.sub(r"%(\d*)d", lambda m: str(f).zfill(int(m[1] or 1)), pattern)
            s = re.sub(r"[#@]+", lambda m: str(f).zfill(padding * m[0].count("#") + m[0].count("@")), s)
            out.append(s.replace("%V", view).replace("%v", view[:1]))
    return out


def parse_option(text: str) -> tuple[str, dict[str, str]]:
    """--op:key=val:key=val; quoted values may hold colons."""
    parts = re.findall(r"""((?:[^:'"]|'[^']*'|"[^"]*")+)""", text)
    options = dict(p.partition("=")[::2] for p in parts[1:])
    return parts[0], {k: v.strip("'\"") for k, v in options.items()}


def floats(text: str) -> list[float]:
    return [float(v) for v in text.split(",")]
