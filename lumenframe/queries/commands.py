"""Queries in the command language, each with SQL for the same pixels or lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.core import Image
from lumenframe.plans.command import Commands, command_line
from lumenframe.queries import captions as K
from lumenframe.queries import perceptual as Q
from lumenframe.queries import rasters as R
from lumenframe.queries import transforms as T

QUERIES: dict = {}
SQL: dict[str, str] = {}

TABLES = {
    "ev": R.ev, "emb": R.emb, "A": lambda s, d: R._li(s, d, "A"), "R": lambda s, d: R._li(s, d, "R"),
    "even": lambda s, d: Q.pair(s, d)[0], "odd": lambda s, d: Q.pair(s, d)[1], "vec": T.lines, "mattes": K.mattes,
}


def done(spark: SparkSession, sf: str, words: str) -> Commands:
    """The commands' end state; names of tables stand for their images."""
    return command_line(spark, words.split(), reader=lambda s, name: TABLES[name](s, sf), config=T.config())


def pixels(name: str, words: str, sql: str, whole: bool = True) -> None:
    """The top image's pixels, all or those with a row; a billionth is added so that no tie is left to the engines' rounding."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        top = done(spark, sf, words).stack[-1]
        out: Image = top.dense() if whole else top
        return R.shown(out.with_channels([c + 1e-9 for c in out.c]))

    QUERIES[f"cmd_{name}"], SQL[f"cmd_{name}"] = query, sql


def lines(name: str, words: str, sql: str) -> None:
    """What the commands print, with the number of each line."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return spark.createDataFrame(list(enumerate(done(spark, sf, words).printed)), "n int, line string")

    QUERIES[f"cmd_{name}"], SQL[f"cmd_{name}"] = query, sql


def _show(values: list[str]) -> str:
    return R._show_sql([f"{v} + 1e-9" for v in values])


def ev(values: list[str], source: str = "d", x: str = "x", y: str = "y", where: str = "true") -> str:
    shown = _show(values).replace("image_id, y, x", f"image_id, cast({y} as int) as y, cast({x} as int) as x")
    return f"{R.EV}, {R.LATTICE} select {shown} from {source}, w where {where}"


def emb(values: list[str]) -> str:
    return f"{R.DENSE} select {_show(values)} from a"


def grid(values: list[str], x0: int, x1: int, y0: int, y1: int) -> str:
    return R.GRID.format(v=", ".join(f"round({e} + 1e-9, 6) + 0.0 as c{i}" for i, e in enumerate(values)), x0=x0, x1=x1, y0=y0, y1=y1)


def both(values: list[str]) -> str:
    return f"{R.LI} select {_show(values)} from a"


c = lambda f, n: [f(i) for i in range(n)]

# --- arithmetic and compositing
pixels("constants", "ev --addc 0.5,1 --mulc 2 --subc 1 --divc 4 --absdiffc 0.25 --maxc 0.1 --minc 50", ev(c(lambda i: f"least(greatest(abs(((c{i} + {(0.5, 1)[i]}) * 2 - 1) / 4 - 0.25), 0.1), 50)", 2)))
pixels("powers", "emb --abs --powc 2,1,0.5,1 --invert --abs", emb([f"abs(1 - pow(abs(c{i}), {(2, 1, 0.5)[i]}))" for i in range(3)] + ["abs(c3)"]))
pixels("sub_abs", "A R --sub --abs", both(c(lambda i: f"abs(a{i} - b{i})", 5)), False)
pixels("max_mad", "A R --max A R --min A --mad", both(c(lambda i: f"greatest(a{i}, b{i}) * least(a{i}, b{i}) + a{i}", 5)), False)
pixels("mul_div", "A R --mul R --div", both(c(lambda i: f"(case when b{i} = 0 then 0.0 else a{i} * b{i} / b{i} end)", 5)), False)
pixels("over", "A R --over", both(c(R.OVER, 5)), False)
pixels("zover", "A R --zover", both(c(lambda i: f"(case when a3 <= b3 then {R.OVER(i)} else {R.UNDER(i)} end)", 5)), False)
pixels("absdiff_scale", "A R --absdiff R --ch R --scale", both(c(lambda i: f"abs(a{i} - b{i}) * b0", 5)), False)
pixels("premult", "emb --abs --premult --unpremult --repremult", emb([f"(case when abs(c3) in (0, 1) then abs(c{i}) else abs(c{i}) * abs(c3) end)" for i in range(3)] + ["abs(c3)"]))
pixels("contrast_clamp", "emb --contrast:black=0.1:white=0.6 --clamp:min=-0.5:max=0.5,1,0.25,1 --saturate 0.4", emb([f"(k0 * 0.2126 + k1 * 0.7152 + k2 * 0.0722) * 0.6 + k{i} * 0.4" for i in range(3)] + ["k3"]).replace("from a", "from (select image_id, y, x, " + ", ".join(f"least(greatest((c{i} - 0.1) / 0.5, -0.5), {v}) as k{i}" for i, v in enumerate((0.5, 1, 0.25, 1))) + " from a) a"))
pixels("ranges", "emb --rangecompress --rangeexpand --mulc 3 --rangecompress", emb([R.COMP(f"(c{i} * 3)") for i in range(3)] + ["c3 * 3"]))
pixels("normalize", "emb --normalize:outcenter=0.5:scale=0.5 --ch R,G,B", emb(c(lambda i: f"(case when {R.LENGTH} = 0 then 0.5 else c{i} / {R.LENGTH} * 0.5 + 0.5 end)", 3)))
pixels("polar", "emb --ch R,G --polar --unpolar", emb(["c0", "c1"]))
pixels("colour", "emb --abs --colorconvert sRGB linear --colorconvert linear sRGB --ccmatrix 0.5,0.1,0,0,0.2,0.5,0.1,0,0,0.2,0.6,0,0.01,0.02,0.03,1", emb([" + ".join(f"abs(c{i}) * {R.M[4 * i + j]}" for i in range(4)) for j in range(4)]))
pixels("colormap", "emb --colormap blue-red", emb([R.clip("c0", "0.0", "1.0"), "0.0", f"1 - {R.clip('c0', '0.0', '1.0')}"]))

# --- channels
pixels("channels", "ev --ch 1,0,=0.5 --nchannels 2 --chnames A,B --chsum:weight=2,3", ev(["c1 * 2 + c0 * 3"]))
pixels("chappend", "ev --dup --mulc 2 --chappend --maxchan", ev(["greatest(c0, c1, c0 * 2, c1 * 2)"]))
pixels("minchan", "emb --minchan", emb(["least(c0, c1, c2, c3)"]))
pixels("layersplit", "ev --chnames left.Y,right.Y --layersplit --sub", ev(["c0 - c1"]))

# --- windows and order
pixels("turns", "ev --flip --rotate180 --flop --transpose", ev(["c0", "c1"], "a", "y", "x"), False)
pixels("quarter", "ev --rotate270", ev(["c0", "c1"], "a", "y", "23 - x"), False)
pixels("shift", "ev --cshift +5+3", ev(["c0", "c1"], "a", "(x + 5) % 24", "(y - y0 + 3) % (y1 - y0) + y0"), False)
pixels("origin", "ev --originoffset +10-4 --fullpixels", ev(["c0", "c1"], "a", "x + 10", "y - 4"), False)
pixels("crop", "ev --crop 6x18+3+2", ev(["c0", "c1"], "a", where="x between 3 and 8 and y between 2 and 19"), False)
pixels("cut", "ev --cut 6x18+3+2", ev(["c0", "c1"], "a", "x - 3", "y - 2", "x between 3 and 8 and y between 2 and 19"), False)
pixels("paste", "--pattern constant:color=9,8 4x4 2 --pattern constant:color=0,1 64x64 2 --paste +2+5", grid([f"case when x between 2 and 5 and y between 5 and 8 then {p} else {q} end" for p, q in ((9.0, 0.0), (8.0, 1.0))], 0, 64, 0, 64))
pixels("mosaic", "--pattern constant:color=0.25 8x8 1 --pattern constant:color=0.5 8x8 1 --mosaic 2x1", grid(["case when x < 8 then 0.25 else 0.5 end"], 0, 16, 0, 8))
pixels("trim", "--create 32x24 1 --box:color=1:fill=1 4,3,8,9 --trim", grid(["1.0"], 4, 9, 3, 10))
pixels("nearest", "ev --resample:interp=0 12x8", R._resampled_sql(12, 8, False))

# --- patterns and drawing
pixels("fill", "--pattern fill:top=0,0.5:bottom=1,0.25 64x64 2", grid(["y / 63.0", "(1 - y / 63.0) * 0.5 + y / 63.0 * 0.25"], 0, 64, 0, 64))
pixels("sides", "--pattern fill:left=0:right=1 64x16 1", grid(["x / 63.0"], 0, 64, 0, 16))
pixels("checker", "--pattern checker:width=8:height=4:color1=0.1:color2=0.9 32x16 1", grid(["case when (x // 8 + y // 4) % 2 = 0 then 0.1 else 0.9 end"], 0, 32, 0, 16))
pixels("drawing", "ev --line:color=1,2 2,2,12,12 --point:color=3,4 5,6 --box:color=7,8:fill=1 14,3,18,9 --fill:color=9,9 2x2+20+20", ev([f"(case when x between 20 and 21 and y between 20 and 21 then 9 when x between 14 and 18 and y between 3 and 9 then {b} when x = 5 and y = 6 then {p} when x = y and x between 2 and 12 then {l} else c{i} end)" for i, (b, p, l) in enumerate(((7.0, 3.0, 1.0), (8.0, 4.0, 2.0)))]))

# --- stack, labels, expressions and control
pixels("stack", "ev --dup --addc 1 --swap --label old --pop old --add", ev(["c0 * 2 + 1", "c1 * 2 + 1"]))
pixels("extract", "ev --dup --mulc 2 --dup --mulc 2 --stackextract 2 --stackreverse --pop --sub", ev(["c0 * -3", "c1 * -3"]))
pixels("expression", "ev --addc {TOP.width*0.25+TOP.nchannels} --mulc {1+1}", ev(["(c0 + 8) * 2", "(c1 + 8) * 2"]))
pixels("loop", "ev --for i 0,4 --addc {i} --endfor --set n 3 --while {n} --mulc 2 --set n {n-1} --endwhile", ev(["(c0 + 6) * 8", "(c1 + 6) * 8"]))
pixels("branch", "ev --if {TOP.nchannels>1} --addc 1 --else --addc 5 --endif --if {TOP.nchannels>2} --mulc 7 --else --mulc 3 --endif", ev(["(c0 + 1) * 3", "(c1 + 1) * 3"]))
pixels("evaluation", "ev --set gain 3 --mulc {gain} --evaloff --echo {gain}", ev(["c0 * 3", "c1 * 3"]))

# --- subimages and deep images
pixels("subimage", "ev --dup --mulc 2 --siappend -a --addc 1 --subimage 1", ev(["c0 * 2 + 1", "c1 * 2 + 1"]))
pixels("sisplit", "ev --dup --mulc 3 --siappend --addc 1 --sisplit --sub", ev(["(c0 + 1) - c0 * 3", "(c1 + 1) - c1 * 3"]))
pixels("selectmip", "--pattern fill:topleft=0:topright=1:bottomleft=2:bottomright=4 64x64 1 --selectmip 6", grid(["1.75"], 0, 1, 0, 1))
pixels("deep", "A --deepen --flatten", f"{R.LI} select {_show(['a0', 'a1', 'a2', 'a4', 'case when a4 > 0 then a3 else 1e30 end'])} from a where exists (select 1 from p where p.y = a.y and p.x = a.x)", False)
pixels("deepmerge", "A --deepen R --deepen --deepmerge --flatten --ch A", f"{R.LI} select {_show(['1 - (1 - a4) * (1 - b4)'])} from a", False)

# --- what is printed
lines("rangecheck", "emb --crop 25x8+0+0 --rangecheck -0.2 0.2", f"{R.DENSE}, found as (select image_id, count(*) filter (where least(c0, c1, c2, c3) < -0.2) as lo, count(*) filter (where greatest(c0, c1, c2, c3) > 0.2) as hi, count(*) filter (where least(c0, c1, c2, c3) >= -0.2 and greatest(c0, c1, c2, c3) <= 0.2) as inside from a where y < 8 group by image_id) select cast(row_number() over (order by image_id) - 1 as int) as n, lo || ' < -0.2, ' || hi || ' > 0.2, ' || inside || ' within range' as line from found")
lines("colorcount", "--pattern constant:color=1,0.5,0.5 256x256 3 --box:color=0,1,0:fill=1 100,100,179,179 --colorcount 0,1,0:1,0.5,0.5:0,0,0", "with p as (select x between 100 and 179 and y between 100 and 179 as inside from range(0, 256) s(y), range(0, 256) t(x)), n as (select count(*) filter (where inside) as a, count(*) filter (where not inside) as b from p) select 0 as n, a || '  0,1,0' as line from n union all select 1, b || '  1,0.5,0.5' from n union all select 2, '0  0,0,0' from n")
lines("info", "ev --attrib artist me --attrib year 7 -v --info --metamatch art --info", f"{R.EV}, h as (select w.y1 - w.y0 as n from w) select 0 as n, '24 x ' || n || ', 2 channels: S, N' as line from h union all select 1, '    artist: me' from h union all select 2, '    year: 7' from h union all select 3, '24 x ' || n || ', 2 channels: S, N' from h union all select 4, '    artist: me' from h")
lines("diff", "--pattern constant:color=0.5 8x8 1 --dup --point:color=0.75 3,4 --fail 0.1 --failpercent 2 --diff", "select 0 as n, 'mean error ' || printf('%g', 0.25 / 64) || ', max error 0.25: WARNING' as line")
lines("echo", "--echo {1+2} --create 4x4 3 --printinfo --set x 5 --echo {x*2}", "select * from (values (0, '3'), (1, '4 x 4, 3 channels: R, G, B'), (2, '10')) v(n, line)")


# --- stencils, resampling and frequencies: the same pixels as the operators'
def alike(name: str, words: str, of: str, nudged: bool = True) -> None:
    """The command's pixels against the SQL of an operator's query; nudged if that SQL adds a billionth."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        top = done(spark, sf, words).stack[-1]
        return R._no_tie(top) if nudged else R.shown(top)

    QUERIES[f"cmd_{name}"], SQL[f"cmd_{name}"] = query, R.SQL[of]


alike("blur", "ev --blur 5x5", "blur", False)
alike("convolve", "ev --kernel gaussian 5x5 --convolve", "convolve", False)
alike("median", "ev --median 3x3", "median", False)
alike("dilate", "ev --dilate 3x5", "dilate", False)
alike("erode", "ev --erode 5x3", "erode", False)
alike("unsharp", "ev --unsharp", "unsharp", False)
alike("laplacian", "ev --laplacian", "laplacian", False)
alike("resize", "ev --resize:filter=triangle 12x10", "resize_triangle")
alike("rotate", f"ev --rotate:center=12,15:filter=triangle {0.3 * 180 / 3.141592653589793!r}", "rotate")
alike("warp", "ev --warp:filter=triangle 1.13,0.07,0,-0.11,0.93,0,1.3,2.1,1", "warp")
alike("fft", "ev --fft", "fft")
alike("ifft", "ev --fft --ifft", "ifft", False)
alike("demosaic", "ev --ch 0 --demosaic", "demosaic")

# --- other names of commands, orientation and the stack
pixels("constants_first", "ev --cadd 0.5,1 --cmul 2 --csub 1 --abs --cpow 2,0.5", ev([f"pow(abs((c{i} + {(0.5, 1)[i]}) * 2 - 1), {(2, 0.5)[i]})" for i in range(2)]))
pixels("rotate90", "ev --rotate90", ev(["c0", "c1"], "a", "y1 - 1 - y", "x"), False)
pixels("flipflop", "ev --flipflop --rotate180 --flip --croptofull", ev(["c0", "c1"], "a", "x", "y1 - 1 - y + y0"), False)
pixels("reorient", "ev --orientcw --reorient", ev(["c0", "c1"], "a", "y1 - 1 - y", "x"), False)
pixels("reorient_back", "ev --orientccw --rotccw --rotcw --orient180 --orientcw --reorient", ev(["c0", "c1"], "a", "23 - x", "y1 - 1 - y + y0"), False)
pixels("to_origin", "ev --origin +3+2 --fullsize 24x400+0+0", ev(["c0", "c1"], "a", "x + 3", "y - y0 + 2"), False)
pixels("popbottom", "emb --stackclear emb ev --popbottom --addc 1 --evaloff --evalon --mulc {1+1}", ev(["(c0 + 1) * 2", "(c1 + 1) * 2"]))
_LIN = "(case when abs(c{i}) <= 0.04045 then abs(c{i}) / 12.92 else pow((abs(c{i}) + 0.055) / 1.055, 2.4) end)"
pixels("tocolorspace", "emb --abs --ch R,G,B --iscolorspace sRGB --tocolorspace lin_rec709", emb([_LIN.format(i=i) for i in range(3)]))

# --- colour transforms and perceptual differences
for _name, _words in (
    ("ociolook", "vec --iscolorspace scene_linear --ociolook:to=color_picking warm,lift"), ("ociolook_inverse", "vec --iscolorspace srgb --ociolook:inverse=1:to=linear lift"),
    ("ociodisplay", "vec --iscolorspace ACEScg --ociodisplay default Wide"), ("ocionamedtransform", "vec --ocionamedtransform:inverse=1 square"),
):
    pixels(_name, _words, T.SQL[_name].replace("+ 1e-9, 5)", "+ 1e-9, 6)"))
pixels("flipdiff", f"even odd --flipdiff:ppd={Q.PPD}:hdr=0 --ch flip", f"{Q._LDR} select image_id, y, x, round(max(flip) + 1e-9, 6) + 0.0 as c0 from flips group by image_id, y, x")
pixels("pdiff", "even odd --pdiff --ch fails", f"{Q._YEE} select image_id, y, x, fails::double as c0 from judged")
pixels("cryptomatte_colors", "mattes --cryptomatte-colors object", K.SQL["cryptomatte_colors"], False)
