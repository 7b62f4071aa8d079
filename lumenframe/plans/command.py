"""The command language: operands go on a stack, operators pop their inputs and push a result.

Commands build plans; nothing runs but where a command asks for it (statistics,
trimming, writing).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.core import Image, Roi, Spec
from lumenframe.functions import types as Y
from lumenframe.operators import arithmetic as A
from lumenframe.operators import color as C
from lumenframe.operators import cryptomatte as M
from lumenframe.operators import deep as D
from lumenframe.operators import filters
from lumenframe.operators import geometry as G
from lumenframe.operators import neighborhood as N
from lumenframe.operators import perceptual as P
from lumenframe.operators import statistics as S
from lumenframe.operators import text as X
from lumenframe.operators import transforms as T
from lumenframe.plans.expression import number, substitute
from lumenframe.plans.geometry import floats, parse_channels, parse_frames, parse_geometry, parse_option
from lumenframe.sources.codecs import CODECS

Options = dict[str, str]


@dataclass(frozen=True)
class Deep:
    """A deep image: rows with samples, and the windows of the flat image it was made of."""

    df: DataFrame
    spec: Spec


@dataclass(frozen=True)
class Parts:
    """The subimages of one image; operators take the first, or all if asked to."""

    images: tuple


def parts(x) -> list:
    return list(x.images) if isinstance(x, Parts) else [x]


def _flattened(a: Deep, o: dict) -> Image:
    flat = D.flatten(a.df).select("image_id", F.lit(0).alias("z"), "y", "x", F.col("R").alias("c0"), F.col("G").alias("c1"), F.col("B").alias("c2"), F.col("A").alias("c3"), F.col("depth").alias("c4"))
    return Image(flat, replace(a.spec, names=("R", "G", "B", "A", "Z")))


@dataclass(frozen=True)
class Op:
    inputs: int
    args: int
    run: Callable[..., Image]


def _roi(a: Image, text: str) -> Roi:
    return parse_geometry(text, a.spec.full)


def _size(text: str) -> tuple[int, int]:
    r = parse_geometry(text)
    return r.width, r.height


def _attribs(a: Image, **values) -> Image:
    return Image(a.df, replace(a.spec, attribs={k: v for k, v in (a.spec.attribs | values).items() if v is not None}))


def _text(a: Image, text: str, o: Options) -> Image:
    """By default in the middle of the image, in white."""
    f = a.spec.full
    x, y, size = int(o.get("x", (f.x0 + f.x1) // 2)), int(o.get("y", (f.y0 + f.y1) // 2)), int(o.get("size", 16))
    return X.render_text(a, text.replace("\\n", "\n"), x, y, size, floats(o.get("color", "1")), None, o.get("xalign", "left"), o.get("yalign", "baseline"), int(o.get("shadow", 0)))


def _resize(a: Image, g: str, o: Options) -> Image:
    r = _roi(a, g)
    return N.resize(a, r.width, r.height, o.get("filter", ""))


def _fill(a: Image, g: str, o: Options) -> Image:
    if "top" in o:
        corners = [floats(o["top"]), floats(o["bottom"])]
    elif "topleft" in o:
        corners = [floats(o[k]) for k in ("topleft", "topright", "bottomleft", "bottomright")]
    else:
        corners = [floats(o.get("color", "1"))]
    n = a.spec.n
    return G.fill_region(a, _roi(a, g), *[(c + c[-1:] * n)[:n] for c in corners])


def _turn(cycle: tuple[int, ...]) -> Callable[[Image, Options], Image]:
    def run(a: Image, o: Options) -> Image:
        now = int(a.spec.attribs.get("Orientation", 1))
        return _attribs(a, Orientation=cycle[now - 1])

    return run


def _points(a: Image, text: str, o: Options) -> Image:
    v, color = [int(x) for x in floats(text)], floats(o.get("color", "1"))
    for x, y in zip(v[::2], v[1::2], strict=True):
        a = G.render_point(a, x, y, color)
    return a


def _lines(a: Image, text: str, o: Options) -> Image:
    v, color = [int(x) for x in floats(text)], floats(o.get("color", "1"))
    points = list(zip(v[::2], v[1::2], strict=True))
    for k, (p, q) in enumerate(zip(points, points[1:], strict=False)):
        a = G.render_line(a, *p, *q, color, k > 0)
    return a


def _nchannels(a: Image, n: str, o: Options) -> Image:
    k = int(n)
    return G.channels(a, [i if i < a.spec.n else -1 for i in range(k)])


def _trim(a: Image, o: Options) -> Image:
    r = S.bounds(a)
    return G.crop(a, r if not r.empty else Roi(a.spec.data.x0, a.spec.data.x0 + 1, a.spec.data.y0, a.spec.data.y0 + 1))


def _const(f) -> Op:
    return Op(1, 1, lambda a, v, o: f(a, floats(v)))


def _plain(f, inputs: int = 1) -> Op:
    return Op(inputs, 0, lambda *x: f(*x[:-1]))


OPS: dict[str, Op] = {
    "add": _plain(A.add, 2),
    "sub": _plain(A.sub, 2),
    "mul": _plain(A.mul, 2),
    "div": _plain(A.div, 2),
    "absdiff": _plain(A.absdiff, 2),
    "max": _plain(A.maximum, 2),
    "min": _plain(A.minimum, 2),
    "mad": _plain(A.mad, 3),
    "scale": _plain(A.scale, 2),
    "over": _plain(A.over, 2),
    "zover": _plain(A.zover, 2),
    "chappend": _plain(G.channel_append, 2),
    "st_warp": _plain(N.st_warp, 2),
    "addc": _const(A.add),
    "cadd": _const(A.add),
    "subc": _const(A.sub),
    "csub": _const(A.sub),
    "mulc": _const(A.mul),
    "cmul": _const(A.mul),
    "divc": _const(A.div),
    "absdiffc": _const(A.absdiff),
    "powc": _const(A.power),
    "cpow": _const(A.power),
    "maxc": _const(A.maximum),
    "minc": _const(A.minimum),
    "saturate": Op(1, 1, lambda a, v, o: A.saturate(a, float(v))),
    "abs": _plain(A.absolute),
    "maxchan": _plain(A.maxchan),
    "minchan": _plain(A.minchan),
    "premult": _plain(A.premult),
    "unpremult": _plain(A.unpremult),
    "repremult": _plain(A.repremult),
    "polar": _plain(A.complex_to_polar),
    "unpolar": _plain(A.polar_to_complex),
    "deepen": Op(1, 0, lambda a, o: Deep(D.deepen(a, float(o.get("z", 1))), a.spec)),
    "flatten": Op(1, 0, _flattened),
    "deepmerge": Op(2, 0, lambda a, b, o: Deep(D.deep_merge(a.df, b.df), a.spec)),
    "deepholdout": Op(2, 0, lambda a, b, o: Deep(D.deep_holdout(a.df, b.df), a.spec)),
    "fft": _plain(N.fft),
    "ifft": _plain(N.ifft),
    "fillholes": _plain(N.fillholes_pushpull),
    "laplacian": _plain(N.laplacian),
    "flip": _plain(G.flip),
    "flop": _plain(G.flop),
    "rotate90": _plain(G.rotate90),
    "rotate180": _plain(G.rotate180),
    "flipflop": _plain(G.rotate180),
    "rotate270": _plain(G.rotate270),
    "transpose": _plain(G.transpose),
    "reorient": _plain(G.reorient),
    "invert": Op(1, 0, lambda a, o: a.dense().with_channels([c if i == a.spec.alpha else 1 - c for i, c in enumerate(a.c)])),
    "rangecompress": Op(1, 0, lambda a, o: A.rangecompress(a, o.get("luma") == "1")),
    "rangeexpand": Op(1, 0, lambda a, o: A.rangeexpand(a, o.get("luma") == "1")),
    "chsum": Op(1, 0, lambda a, o: A.channel_sum(a, floats(o.get("weight", "1")))),
    "colormap": Op(1, 1, lambda a, v, o: A.color_map(a, A.COLOR_MAPS[v] if v in A.COLOR_MAPS else [floats(v)[i : i + 3] for i in range(0, len(floats(v)), 3)])),
    "clamp": Op(1, 0, lambda a, o: A.clamp(a, floats(o.get("min", "-inf")), floats(o.get("max", "inf")), o.get("clampalpha") == "1")),
    "contrast": Op(1, 0, lambda a, o: A.contrast_remap(a, *[floats(o.get(k, d)) for k, d in (("black", "0"), ("white", "1"), ("min", "0"), ("max", "1"), ("scontrast", "1"), ("sthresh", "0.5"))])),
    "normalize": Op(1, 0, lambda a, o: A.normalize(a, float(o.get("incenter", 0)), float(o.get("outcenter", 0)), float(o.get("scale", 1)))),
    "noise": Op(1, 0, lambda a, o: G.noise(a.dense(), o.get("type", "gaussian"), float(o.get("mean", o.get("min", o.get("value", 0)))), float(o.get("stddev", o.get("max", o.get("portion", 0.1)))), o.get("mono") == "1", int(o.get("seed", 0)))),
    "crop": Op(1, 1, lambda a, g, o: G.crop(a, _roi(a, g))),
    "cut": Op(1, 1, lambda a, g, o: G.cut(a, _roi(a, g))),
    "croptofull": Op(1, 0, lambda a, o: G.crop(a, a.spec.full)),
    "trim": Op(1, 0, _trim),
    "cshift": Op(1, 1, lambda a, g, o: G.circular_shift(a, *[int(x) for x in re.findall(r"[+-]\d+", g)])),
    "paste": Op(2, 1, lambda fg, bg, g, o: G.paste(bg, parse_geometry(g).x0, parse_geometry(g).y0, fg)),
    "resize": Op(1, 1, _resize),
    "resample": Op(1, 1, lambda a, g, o: N.resample(a, _roi(a, g).width, _roi(a, g).height, o.get("interp", "1") == "1")),
    "fit": Op(1, 1, lambda a, g, o: N.fit(a, *_size(g), o.get("filter", ""), o.get("fillmode", "letterbox"))),
    "rotate": Op(1, 1, lambda a, v, o: N.rotate(a, float(v) * 3.141592653589793 / 180, tuple(floats(o["center"])) if "center" in o else None, o.get("filter", "lanczos3"))),
    "warp": Op(1, 1, lambda a, v, o: N.warp(a, floats(v), o.get("filter", "lanczos3"))),
    "convolve": Op(2, 0, lambda a, k, o: N.convolve(a, {(r["x"], r["y"]): r["c0"] for r in k.df.collect()})),
    "blur": Op(1, 1, lambda a, g, o: N.blur(a, o.get("kernel", "gaussian"), *map(float, g.split("x")))),
    "median": Op(1, 1, lambda a, g, o: N.median_filter(a, *_size(g))),
    "dilate": Op(1, 1, lambda a, g, o: N.dilate(a, *_size(g))),
    "erode": Op(1, 1, lambda a, g, o: N.erode(a, *_size(g))),
    "unsharp": Op(1, 0, lambda a, o: N.unsharp_mask(a, o.get("kernel", "gaussian"), float(o.get("width", 3)), float(o.get("contrast", 1)), float(o.get("threshold", 0)))),
    "fixnan": Op(1, 1, lambda a, m, o: N.fix_non_finite(a, m)),
    "demosaic": Op(1, 0, lambda a, o: N.demosaic(a, o.get("layout", "RGGB"))),
    "cryptomatte-colors": Op(1, 1, lambda a, layer, o: M.colors(a, layer)),
    "line": Op(1, 1, _lines),
    "text": Op(1, 1, _text),
    "point": Op(1, 1, _points),
    "fill": Op(1, 1, _fill),
    "box": Op(1, 1, lambda a, v, o: G.render_box(a, *[int(x) for x in floats(v)], floats(o.get("color", "1")), o.get("fill") == "1")),
    "ch": Op(1, 1, lambda a, v, o: G.channels(a, *parse_channels(v, a.spec.names))),
    "nchannels": Op(1, 1, _nchannels),
    "chnames": Op(1, 1, lambda a, v, o: Image(a.df, replace(a.spec, names=tuple((v.split(",") + list(a.spec.names[len(v.split(",")) :]))[: a.spec.n])))),
    "colorconvert": Op(1, 2, lambda a, s, t, o: _attribs(C.convert(a, s, t, o.get("unpremult") == "1"), colorspace=t)),
    "tocolorspace": Op(1, 1, lambda a, t, o: _attribs(C.convert(a, a.spec.attribs.get("colorspace", "lin_rec709"), t), colorspace=t)),
    "iscolorspace": Op(1, 1, lambda a, t, o: _attribs(a, colorspace=t)),
    "ccmatrix": Op(1, 1, lambda a, v, o: A.color_matrix(a, floats(v), o.get("unpremult") == "1")),
    "attrib": Op(1, 2, lambda a, k, v, o: _attribs(a, **{k: number(v)})),
    "sattrib": Op(1, 2, lambda a, k, v, o: _attribs(a, **{k: v})),
    "caption": Op(1, 1, lambda a, v, o: _attribs(a, ImageDescription=v)),
    "eraseattrib": Op(1, 1, lambda a, p, o: _attribs(a, **{k: None for k in a.spec.attribs if re.search(p, k)})),
    "keyword": Op(1, 1, lambda a, v, o: _attribs(a, Keywords="; ".join(filter(None, [a.spec.attribs.get("Keywords", ""), v])))),
    "clear-keywords": Op(1, 0, lambda a, o: _attribs(a, Keywords=None)),
    "orientation": Op(1, 1, lambda a, v, o: _attribs(a, Orientation=int(v))),
    "orientcw": Op(1, 0, _turn((6, 7, 8, 5, 2, 3, 4, 1))),
    "orientccw": Op(1, 0, _turn((8, 5, 6, 7, 4, 1, 2, 3))),
    "orient180": Op(1, 0, _turn((3, 4, 1, 2, 7, 8, 5, 6))),
    "origin": Op(1, 1, lambda a, g, o: _moved(a, parse_geometry(g).x0 - a.spec.data.x0, parse_geometry(g).y0 - a.spec.data.y0)),
    "originoffset": Op(1, 1, lambda a, g, o: _moved(a, parse_geometry(g).x0, parse_geometry(g).y0)),
    "fullsize": Op(1, 1, lambda a, g, o: Image(a.df, replace(a.spec, full=_roi(a, g)))),
    "fullpixels": Op(1, 0, lambda a, o: Image(a.df, replace(a.spec, full=a.spec.data))),
}
for _old, _new in (("rotcw", "orientcw"), ("rotccw", "orientccw"), ("rot180", "orient180")):
    OPS[_old] = OPS[_new]


def _moved(a: Image, dx: int, dy: int) -> Image:
    return a.moved(F.col("x") + dx, F.col("y") + dy, a.spec.data.shifted(dx, dy))


@dataclass
class Commands:
    spark: SparkSession
    reader: Callable[[SparkSession, str], Image]
    writer: Callable[[Image, str], None]
    stack: list = field(default_factory=list)
    labels: dict[str, Image] = field(default_factory=dict)
    variables: dict[str, str] = field(default_factory=dict)
    printed: list[str] = field(default_factory=list)
    frame: int = 0
    config: T.Config = field(default_factory=T.default_config)

    def pop(self) -> Image:
        if not self.stack:
            raise ValueError("no image on the stack")
        return self.stack.pop()

    def lookup(self, name: str, path: list):
        if name == "var":
            return number(self.variables[path[0]])
        if name == "getattribute":
            return self.spark.conf.get(path[0], None) or self._raise(path[0])
        if name == "FRAME_NUMBER":
            return self.frame
        if name == "NIMAGES":
            return len(self.stack)
        if name in self.variables:
            return number(self.variables[name])
        if name == "IMG":
            index = path[0][0]
            image, path = self.labels[index] if index in self.labels else self.stack[-1 - int(index)], path[1:]
        else:
            image = {"TOP": lambda: self.stack[-1], "BOTTOM": lambda: self.stack[0]}[name]()
        return self._meta(image, path[0][0] if isinstance(path[0], list) else path[0], isinstance(path[0], list))

    def _raise(self, key: str):
        raise KeyError(key)

    def _meta(self, top, key: str, lenient: bool):
        count, a = len(parts(top)), parts(top)[0]
        d, f = a.spec.data, a.spec.full
        plain = {"x": d.x0, "y": d.y0, "width": d.width, "height": d.height, "full_x": f.x0, "full_y": f.y0, "full_width": f.width, "full_height": f.height, "nchannels": a.spec.n, "channelnames": ",".join(a.spec.names), "alpha_channel": a.spec.alpha, "z_channel": a.spec.zchannel, "SUBIMAGES": count}
        if key in plain:
            return plain[key]
        if key in a.spec.attribs:
            return a.spec.attribs[key]
        column = {"MINCOLOR": "min", "MAXCOLOR": "max", "AVGCOLOR": "avg"}.get(key)
        if column:
            return ",".join(f"{r[column]:g}" for r in S.pixel_stats(a.dense()).orderBy("c").collect())
        if key == "NONFINITE_COUNT":
            return S.pixel_stats(a).agg(F.sum(F.col("nan") + F.col("inf"))).first()[0]
        if key == "IS_CONSTANT":
            return int(S.is_constant_color(a.dense()).first()["constant"])
        if key == "IS_BLACK":
            return int(S.bounds(a).empty)
        if lenient:
            return ""
        raise ValueError(f"no metadata {key!r}")

    def run(self, words: list[str]) -> Commands:
        at = 0
        while at < len(words):
            at = self._step(words, at)
        return self

    def _block(self, words: list[str], at: int, begin: str, ends: tuple[str, ...]) -> int:
        depth = 0
        for k in range(at, len(words)):
            if words[k].startswith(begin):
                depth += 1
            elif words[k] in ends and depth == 0:
                return k
            elif words[k] == ends[-1]:
                depth -= 1
        raise ValueError(f"{begin} without {ends[-1]}")

    def _step(self, words: list[str], at: int) -> int:
        raw = words[at]
        if not raw.startswith("-"):
            name = self.value(raw)
            self.stack.append(self.labels[name] if name in self.labels else self.read(name))
            return at + 1
        name, options = parse_option(raw.lstrip("-"))
        options = {k: self.value(v) for k, v in options.items()}
        arg = lambda k=1: self.value(words[at + k])
        if name == "if":
            other = self._block(words, at + 2, "--if", ("--else", "--endif"))
            end = self._block(words, at + 2, "--if", ("--endif",))
            if self.true(arg()):
                self.run(words[at + 2 : other])
            elif words[other] == "--else":
                self.run(words[other + 1 : end])
            return end + 1
        if name == "while":
            end = self._block(words, at + 2, "--while", ("--endwhile",))
            while self.true(arg()):
                self.run(words[at + 2 : end])
            return end + 1
        if name in ("for", "frames"):
            if name == "frames":
                frames, body, end, variable = parse_frames(arg()), words[at + 2 :], len(words) - 1, None
            else:
                end = self._block(words, at + 3, "--for", ("--endfor",))
                r = [int(float(v)) for v in self.value(words[at + 2]).split(",")]
                frames, body, variable = list(range(*r)), words[at + 3 : end], arg()
            for f in frames:
                self.frame = f
                if variable:
                    self.variables[variable] = str(f)
                self.run(body)
            return end + 1
        if name in BUILTIN:
            n, f = BUILTIN[name]
            f(self, *[arg(k + 1) for k in range(n)], options)
            return at + 1 + n
        if name not in OPS:
            raise ValueError(f"unknown command {raw!r}")
        op = OPS[name]
        args = [arg(k + 1) for k in range(op.args)]  # these may ask about the inputs
        inputs = [self.pop() for _ in range(op.inputs)][::-1]
        self.stack.append(self.applied(op, inputs, args, options, " ".join([raw, *args])))
        return at + 1 + op.args

    def applied(self, op: Op, inputs: list, args: list[str], options: Options, said: str):
        """The operator's result: on the first subimages, or, if all are asked for, on all that the inputs have side by side."""
        every = options.get("allsubimages", self.variables.get("allsubimages", "0")) == "1"
        sides = [parts(x) for x in inputs]
        rows = list(zip(*sides, strict=False)) if every else [tuple(p[0] for p in sides)]
        made = [self._noted(op.run(*row, *args, options), said) for row in rows]
        rest = sides[0][1:] if not every and len(sides) == 1 else []
        return made[0] if len(made) + len(rest) == 1 else Parts((*made, *rest))

    def _noted(self, made, said: str):
        """With the command in the image's history."""
        if not isinstance(made, Image) or self.variables.get("history", "0") != "1":
            return made
        return _attribs(made, history="; ".join(filter(None, [made.spec.attribs.get("history", ""), said])))

    def say(self, text: str) -> None:
        if self.variables.get("quiet") != "1":
            self.printed.append(text)

    def read(self, path: str) -> Image:
        """A file's image; one that is missing is black or a checkerboard, if missingfile says so."""
        try:
            return self.reader(self.spark, path)
        except (FileNotFoundError, AnalysisException):
            kind = self.variables.get("missingfile", "error")
            if kind == "error":
                raise
            like = parts(self.stack[-1])[0].spec if self.stack else None
            roi, n = (like.full, like.n) if like else (Roi(0, 64, 0, 64), 3)
            return G.zero(self.spark, roi, n) if kind == "black" else G.checker(self.spark, roi, 8, 8, 1, [0.0] * n, [1.0] * n)

    def write(self, path: str) -> None:
        """The top image goes to the writer: trimmed, quantised and with the attributes that the settings ask for."""
        out = parts(self.stack[-1])[0]
        if self.variables.get("autotrim") == "1":
            out = _trim(out, {})
        kind = self.variables.get("datatype", "float")
        if kind not in ("float", "half", "double"):
            out = out.with_channels([Y.convert(Y.convert(c, "float", kind), kind, "float") for c in out.c], list(out.spec.names))
        if self.variables.get("sansattrib") == "1":
            out = _attribs(out, **dict.fromkeys(out.spec.attribs))
        elif self.variables.get("software", "1") == "1":
            out = _attribs(out, Software=f"lumenframe {'; '.join(filter(None, [out.spec.attribs.get('history', '')]))}".strip())
        if self.variables.get("dryrun") != "1":
            self.writer(out, path)

    def info(self, top) -> None:
        """Size and channels of all subimages, and the attributes that the settings let through."""
        for k, a in enumerate(parts(top)):
            spec = a.spec
            names = f"{spec.n} channels: {', '.join(spec.names)}" if isinstance(a, Image) else "deep"
            self.say(f"{'' if k == 0 else f'subimage {k}: '}{spec.data.width} x {spec.data.height}, {names}")
            wanted, without = self.variables.get("metamatch"), self.variables.get("nometamatch")
            for key, v in sorted(spec.attribs.items()) if self.variables.get("verbose") == "1" or wanted else ():
                if (not wanted or re.search(wanted, key, re.I)) and not (without and re.search(without, key, re.I)):
                    self.say(f"    {key}: {v}")

    def dump(self, o: Options) -> None:
        """The pixels of the top image in scan order; without empty ones if empty=0."""
        a = parts(self.stack[-1])[0]
        rows = (a if o.get("empty") == "0" else a.dense()).df.orderBy("image_id", "z", "y", "x").toLocalIterator()
        for r in rows:
            self.say(f"Pixel ({r['x']}, {r['y']}): {' '.join(f'{r[f"c{i}"]:g}' for i in range(a.spec.n))}")

    def value(self, text: str) -> str:
        if self.variables.get("evaloff") == "1":
            return text
        return substitute(text, self.lookup) if "{" in text else text

    @staticmethod
    def true(text: str) -> bool:
        return text not in ("", "0", "false", "False")

    def _pattern(self, kind: str, geometry: str, n: str, o: Options) -> None:
        head, own = parse_option(kind)
        roi, n = parse_geometry(geometry), int(n)
        color = lambda k, d: (floats(own.get(k, d)) + floats(own.get(k, d))[-1:] * n)[:n]
        if head == "checker":
            size = int(own.get("width", 16))
            made = G.checker(self.spark, roi, size, int(own.get("height", size)), 1, color("color1", "0"), color("color2", "1"))
        elif head == "constant":
            made = G.fill(self.spark, roi, color("color", "1"))
        elif head == "fill":
            keys = ("top", "bottom") if "top" in own else ("left", "right") if "left" in own else ("topleft", "topright", "bottomleft", "bottomright")
            c = [color(k, "1") for k in keys]
            made = G.fill(self.spark, roi, *([c[0], c[1], c[0], c[1]] if keys[0] == "left" else c))
        elif head == "noise":
            made = OPS["noise"].run(G.zero(self.spark, roi, n), own)
        elif head == "black":
            made = G.zero(self.spark, roi, n)
        else:
            raise ValueError(f"unknown pattern {kind!r}")
        self.stack.append(made)

    def _compare(self, o: Options) -> None:
        b, a = self.pop(), self.pop()
        at = lambda name, default: float(self.variables.get(name, default))
        for p, q in zip(parts(a), parts(b), strict=False):
            found = S.compare(p, q, at("fail", 1e-6), at("warn", 1e-6), at("failrelative", 0), at("warnrelative", 0))
            rows = S.diff_status(found, p.spec.data.union(q.spec.data).pixels, at("failpercent", 0), at("hardfail", "inf"), at("warnpercent", 0), at("hardwarn", "inf"))
            for r in rows.orderBy("image_id").collect():
                self.say(f"mean error {r['mean_error']:g}, max error {r['max_error']:g}: {r['status']}")


def _perceptual(c: Commands, metric: Callable[[Image, Image, Options], Image], o: Options) -> None:
    """The error map of the two top images takes their place."""
    b, a = c.pop(), c.pop()
    c.stack.append(metric(a, b, o))


def _flip(a: Image, b: Image, o: Options) -> Image:
    hdr = P.Exposures(o.get("tonemapper", "aces"), float(o.get("maxluminance", 2)), float(o.get("medianluminance", 0.18)), count=int(o.get("exposures", 0)))
    return P.flip_diff(a, b, float(o.get("ppd", P.PIXELS_PER_DEGREE)), None if o.get("hdr") == "0" else hdr)


def _transform(c: Commands, steps: Callable[[str], list], o: Options, colorspace: str | None = None) -> None:
    """The top image through the steps that its present colour space asks for."""
    a = c.pop()
    now = o.get("from", a.spec.attribs.get("colorspace", "scene_linear"))
    c.stack.append(T.apply(a, steps(now), o.get("unpremult") == "1", colorspace))


def _look(c: Commands, names: str, o: Options) -> None:
    now = c.stack[-1].spec.attribs.get("colorspace", "scene_linear")
    target = o.get("to", now)
    _transform(c, lambda s: c.config.through_looks(names.replace("+", ","), s, target, o.get("inverse") == "1"), o, c.config.space(target))


def _display(c: Commands, display: str, view: str, o: Options) -> None:
    _transform(c, lambda s: c.config.to_display(display, view, s, o.get("looks"), o.get("inverse") == "1"), o)


def _file_transform(c: Commands, path: str, o: Options) -> None:
    step = T.read_cube(c.spark.read.text(path, wholetext=True).first()[0])
    _transform(c, lambda s: [step.inverse() if o.get("inverse") == "1" else step], o)


def _siappend(c: Commands, n: int) -> None:
    """The last n images as the subimages of one."""
    own = [c.pop() for _ in range(n)][::-1]
    c.stack.append(Parts(tuple(p for x in own for p in parts(x))))


def _layers(a: Image) -> list[Image]:
    """An image for each layer: channels whose names begin alike up to the last dot."""
    layers: dict[str, list[int]] = {}
    for i, name in enumerate(a.spec.names):
        layers.setdefault(name.rpartition(".")[0], []).append(i)
    return [G.channels(a, own, names=[a.spec.names[i].rpartition(".")[2] for i in own]) for own in layers.values()]


def _swap(c: Commands, o: Options) -> None:
    c.stack[-1], c.stack[-2] = c.stack[-2], c.stack[-1]


def _mosaic(c: Commands, g: str, o: Options) -> None:
    w, h = _size(g)
    images = [c.pop() for _ in range(min(w * h, len(c.stack)))][::-1]
    c.stack.append(G.mosaic(images, w, int(o.get("pad", 0))))


def _stats(c: Commands, o: Options) -> None:
    c.printed += [f"{r['image_id']} c{r['c']} min {r['min']:g} max {r['max']:g} avg {r['avg']:g} stddev {r['stddev']:g}" for r in S.pixel_stats(c.stack[-1].dense()).orderBy("image_id", "c").collect()]


def _colorcount(c: Commands, text: str, o: Options) -> None:
    rows = S.color_count(c.stack[-1].dense(), [floats(t) for t in text.split(":")], floats(o.get("eps", "0.001"))).orderBy("image_id", "color")
    c.printed += [f"{r['n']}  {text.split(':')[r['color']]}" for r in rows.collect()]


def _rangecheck(c: Commands, low: str, high: str, o: Options) -> None:
    c.printed += [f"{r['n_low']} < {low}, {r['n_high']} > {high}, {r['n_in']} within range" for r in S.color_range_check(c.stack[-1].dense(), floats(low), floats(high)).orderBy("image_id").collect()]


def _set(c: Commands, name: str, v: str, o: Options) -> None:
    c.variables[name] = v


#: Commands that work on the stack or the settings, with the number of their arguments.
BUILTIN: dict[str, tuple[int, Callable]] = {
    "i": (1, lambda c, p, o: c.stack.append(c.read(p))),
    "o": (1, lambda c, p, o: c.write(p)),
    "create": (2, lambda c, g, n, o: c._pattern("black", g, n, o)),
    "pattern": (3, Commands._pattern),
    "kernel": (2, lambda c, k, g, o: c.stack.append(N.make_kernel(c.spark, k, *map(float, g.split("x"))))),
    "dup": (0, lambda c, o: c.stack.append(c.stack[-1])),
    "pop": (0, lambda c, o: c.pop()),
    "popbottom": (0, lambda c, o: c.stack.pop(0)),
    "swap": (0, _swap),
    "stackreverse": (0, lambda c, o: c.stack.reverse()),
    "stackextract": (1, lambda c, i, o: c.stack.append(c.stack.pop(-1 - int(i)))),
    "stackclear": (0, lambda c, o: c.stack.clear()),
    "label": (1, lambda c, n, o: c.labels.__setitem__(n, c.stack[-1])),
    "set": (2, _set),
    "fail": (1, lambda c, v, o: _set(c, "fail", v, o)),
    "warn": (1, lambda c, v, o: _set(c, "warn", v, o)),
    "echo": (1, lambda c, t, o: c.say(t)),
    "mosaic": (1, _mosaic),
    "diff": (0, Commands._compare),
    "flipdiff": (0, lambda c, o: _perceptual(c, _flip, o)),
    "pdiff": (0, lambda c, o: _perceptual(c, lambda a, b, o: P.visible_differences(a, b, float(o.get("luminance", 100)), float(o.get("fov", 45))), o)),
    "ociolook": (1, _look),
    "ociodisplay": (2, _display),
    "ociofiletransform": (1, _file_transform),
    "ocionamedtransform": (1, lambda c, n, o: _transform(c, lambda s: c.config.by_name(n, o.get("inverse") == "1"), o)),
    "colorconfiginfo": (0, lambda c, o: c.printed.extend(" ".join(filter(None, r)) for r in c.config.inventory())),
    "printstats": (0, _stats),
    "stats": (0, _stats),
    "colorcount": (1, _colorcount),
    "rangecheck": (2, _rangecheck),
    "hash": (0, lambda c, o: c.printed.extend(r["sha1"] for r in S.pixel_hash(c.stack[-1].dense()).collect())),
    "printinfo": (0, lambda c, o: c.printed.append(f"{c.stack[-1].spec.data.width} x {c.stack[-1].spec.data.height}, {c.stack[-1].spec.n} channels: {', '.join(c.stack[-1].spec.names)}")),
    "list-formats": (0, lambda c, o: c.printed.append(", ".join(sorted(CODECS)))),
    "list-filters": (0, lambda c, o: c.printed.append(", ".join(sorted(filters.FILTERS)))),
    "v": (0, lambda c, o: _set(c, "verbose", "1", o)),
    "q": (0, lambda c, o: _set(c, "quiet", "1", o)),
    "a": (0, lambda c, o: _set(c, "allsubimages", "1", o)),
    "n": (0, lambda c, o: _set(c, "dryrun", "1", o)),
    "evaloff": (0, lambda c, o: _set(c, "evaloff", "1", o)),
    "evalon": (0, lambda c, o: _set(c, "evaloff", "0", o)),
    "no-history": (0, lambda c, o: _set(c, "history", "0", o)),
    "history": (0, lambda c, o: _set(c, "history", "1", o)),
    "nosoftwareattrib": (0, lambda c, o: _set(c, "software", "0", o)),
    "sansattrib": (0, lambda c, o: _set(c, "sansattrib", "1", o)),
    "autotrim": (0, lambda c, o: _set(c, "autotrim", "1", o)),
    "d": (1, lambda c, t, o: _set(c, "datatype", t, o)),
    "metamatch": (1, lambda c, p, o: _set(c, "metamatch", p, o)),
    "no-metamatch": (1, lambda c, p, o: _set(c, "nometamatch", p, o)),
    "failpercent": (1, lambda c, v, o: _set(c, "failpercent", v, o)),
    "hardfail": (1, lambda c, v, o: _set(c, "hardfail", v, o)),
    "warnpercent": (1, lambda c, v, o: _set(c, "warnpercent", v, o)),
    "hardwarn": (1, lambda c, v, o: _set(c, "hardwarn", v, o)),
    "failrelative": (1, lambda c, v, o: _set(c, "failrelative", v, o)),
    "warnrelative": (1, lambda c, v, o: _set(c, "warnrelative", v, o)),
    "missingfile": (1, lambda c, v, o: _set(c, "missingfile", v, o)),
    "version": (0, lambda c, o: c.say(f"lumenframe on Spark {c.spark.version}")),
    "buildinfo": (0, lambda c, o: c.say(f"lumenframe on Spark {c.spark.version}, formats: {', '.join(sorted(CODECS))}")),
    "help": (0, lambda c, o: c.say(" ".join(f"--{n}" for n in sorted({*OPS, *BUILTIN})))),
    "info": (0, lambda c, o: c.info(c.stack[-1])),
    "dumpdata": (0, lambda c, o: c.dump(o)),
    "siappend": (0, lambda c, o: _siappend(c, 2)),
    "siappendall": (0, lambda c, o: _siappend(c, len(c.stack))),
    "sisplit": (0, lambda c, o: c.stack.extend(parts(c.pop()))),
    "subimage": (1, lambda c, n, o: c.stack.append(parts(c.pop())[int(n)])),
    "layersplit": (0, lambda c, o: c.stack.extend(_layers(c.pop()))),
    "selectmip": (1, lambda c, n, o: c.stack.append(N.pyramid(parts(c.pop())[0])[int(n)])),
    "unmip": (0, lambda c, o: None),
}


def command_line(spark: SparkSession, words: list[str], reader=None, writer=None, config: T.Config | None = None) -> Commands:
    from lumenframe.sources import files

    writer = writer or (lambda a, p: files.encoded(a, p).write.mode("overwrite").parquet(p))
    return Commands(spark, reader or files.read, writer, config=config or T.default_config()).run(words)
