import pytest

from lumenframe.core import Roi
from lumenframe.plans.command import command_line
from lumenframe.plans.expression import Expression
from lumenframe.plans.geometry import expand_frames, parse_channels, parse_frames, parse_geometry, parse_option


@pytest.mark.parametrize(
    ("text", "want"),
    [("64x48", Roi(0, 64, 0, 48)), ("64x48+10-5", Roi(10, 74, -5, 43)), ("1,2,3,4", Roi(1, 4, 2, 5)), ("50%", Roi(0, 50, 0, 25)), ("50%x100%", Roi(0, 50, 0, 50)), ("0x25", Roi(0, 50, 0, 25)), ("+3+4", Roi(3, 103, 4, 54))],
)
def test_geometry(text, want):
    assert parse_geometry(text, Roi(0, 100, 0, 50)) == want


def test_parsers():
    assert parse_channels("R,2,new=G,A=0.5,nope", ("R", "G", "B")) == ([0, 2, 1, -1, -1], [0.0, 0.0, 0.0, 0.5, 0.0], ["R", "B", "new", "A", "nope"])
    assert parse_frames("1-10x3") == [1, 4, 7, 10] and parse_frames("1-5y2") == [2, 4] and parse_frames("3,1-3") == [3, 1, 2]
    assert expand_frames("a.#.%V.exr", [7], views=("left", "right")) == ["a.0007.left.exr", "a.0007.right.exr"]
    assert expand_frames("b@@.%03d", [5]) == ["b05.005"]
    assert parse_option("fill:color=1,2:name='a:b'") == ("fill", {"color": "1,2", "name": "a:b"})
    with pytest.raises(ValueError, match="geometry"):
        parse_geometry("nonsense")


@pytest.mark.parametrize(
    ("text", "want"),
    [("1+2*3", 7), ("(1+2)*3", 9), ("7//2", 3), ("-7//2", -3), ("-7%3", -1), ("1/4", 0.25), ("3<=>2", 1), ("1<2 && !0", 1), ("eq('a','b')", 0), ("not(0) || 0", 1), ("5/0", 0), ("'x' == 'x'", 1)],
)
def test_expressions(text, want):
    assert Expression(text, lambda n, p: 0).evaluate() == want


def test_commands(spark):
    line = "--pattern constant:color=1,0.5,0.5 64x64 3 --fill:color=0,1,0 20x20+10+10 --colorcount 0,1,0:1,.5,.5:0,0,0 --set n 3 --if {var(n)>2} --mulc {1.0/2} --else --mulc 9 --endif --echo {TOP.MAXCOLOR} --for i 0,3 --addc {i} --endfor --resize 50% --printinfo --label a --dup --flip a --diff"
    out = command_line(spark, line.split())
    assert out.printed[:3] == ["400  0,1,0", "3696  1,.5,.5", "0  0,0,0"]
    assert out.printed[3:5] == ["0.5,0.5,0.25", "32 x 32, 3 channels: R, G, B"]
    assert "FAILURE" in out.printed[5] and len(out.stack) == 1
    with pytest.raises(ValueError, match="unknown command"):
        command_line(spark, ["--nope"])
