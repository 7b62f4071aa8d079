import pytest

from lumenframe.plans.command import BUILTIN, OPS, Commands, Deep, Parts, command_line


@pytest.fixture
def run(spark):
    written = {}

    def go(words):
        def missing(s, name):
            raise FileNotFoundError(name)

        c = command_line(spark, words.split(), reader=missing, writer=lambda a, p: written.__setitem__(p, a))
        c.written = written
        return c

    return go


def first(c: Commands):
    return c.stack[-1].dense().df.orderBy("y", "x").first()


def test_names_are_told_apart():
    assert not set(OPS) & set(BUILTIN) and len(OPS) + len(BUILTIN) > 160


def test_subimages(run):
    c = run("--create 2x2 1 --addc 1 --dup --addc 1 --dup --addc 1 --siappendall --addc 10")
    assert isinstance(c.stack[-1], Parts) and len(c.stack) == 1
    assert [p.dense().df.first()["c0"] for p in c.stack[-1].images] == [11, 2, 3]
    c.run("-a --mulc 2 --echo {TOP.SUBIMAGES} --info --sisplit".split())
    assert [x.dense().df.first()["c0"] for x in c.stack] == [22, 4, 6]
    assert c.printed == ["3", "2 x 2, 1 channels: Y", "subimage 1: 2 x 2, 1 channels: Y", "subimage 2: 2 x 2, 1 channels: Y"]


def test_layers(run):
    c = run("--create 2x2 4 --addc 1,2,3,4 --chnames left.R,left.G,right.R,right.G --layersplit")
    assert [x.spec.names for x in c.stack] == [("R", "G"), ("R", "G")] and first(c)["c1"] == 4


def test_deep(run):
    c = run("--pattern constant:color=0.5,0.25,0.1,0.5,3 2x2 5 --chnames R,G,B,A,Z --deepen --dup --deepmerge --flatten")
    r = first(c)
    assert r["c3"] == pytest.approx(0.75) and r["c4"] == pytest.approx(3)
    assert isinstance(run("--create 2x2 1 --deepen").stack[-1], Deep)


def test_writing(run):
    c = run("--history --create 8x8 1 --box:color=0.31:fill=1 2,3,4,4 --autotrim -d uint8 -o a.png -n -o b.png")
    a = c.written["a.png"]
    assert set(c.written) == {"a.png"} and (a.spec.data.x0, a.spec.data.width, a.spec.data.height) == (2, 3, 2)
    assert first(Commands(c.spark, None, None, [a]))["c0"] == pytest.approx(79 / 255)
    assert "--box" in a.spec.attribs["history"] and a.spec.attribs["Software"].startswith("lumenframe")
    assert "Software" not in run("--sansattrib --create 2x2 1 --attrib k 1 -o c.png").written["c.png"].spec.attribs


def test_missing_files(run):
    with pytest.raises(FileNotFoundError):
        run("nothing.tif")
    assert first(run("--missingfile black nothing.tif"))["c0"] == 0
    assert run("--missingfile checker nothing.tif").stack[-1].dense().df.filter("c0 = 1").count() == 64 * 32


def test_printing(run):
    assert run("--create 2x1 2 --point:color=1,0.5 1,0 --dumpdata").printed == ["Pixel (0, 0): 0 0", "Pixel (1, 0): 1 0.5"]
    assert run("-q --echo no").printed == [] and "--siappend" in run("--help").printed[0] and "tiff" in run("--buildinfo").printed[0]
    base = "--pattern constant:color=0.5 10x10 1 --dup --point:color=0.75 3,4 "
    for settings, want in (("--fail 0.1 --warn 0.1", "FAILURE"), ("--fail 0.1 --failpercent 2 --warn 0.1 --warnpercent 2", "PASS"), ("--fail 0.1 --failpercent 2 --hardfail 0.2", "FAILURE"), ("--fail 0.5 --warn 0.1", "WARNING"), ("--fail 0.1 --failrelative 0.5 --warn 0.5", "PASS"), ("--fail 0.5 --warn 0.5 --hardwarn 0.2", "WARNING")):
        assert run(f"{base}{settings} --diff").printed[0].endswith(want), settings


def test_arguments_see_the_inputs(run):
    assert first(run("--create 6x2 1 --addc {TOP.width}"))["c0"] == 6
    assert run("--evaloff --echo {1+1}").printed == ["{1+1}"]


def test_evaluation_on_again(run):
    c = run("--set gain 3 --evaloff --echo {gain} --evalon --echo {gain}")
    assert c.printed == ["{gain}", "3"]


def test_transforms_and_differences(run, tmp_path):
    (tmp_path / "half.cube").write_text("LUT_1D_SIZE 2\n0 0 0\n0.5 0.5 0.5\n")
    c = run(f"--pattern constant:color=0.5,0.25,1 3x2 3 --ociofiletransform {tmp_path}/half.cube --iscolorspace lin_rec709 --ociodisplay sRGB Standard --colorconfiginfo")
    assert first(c)["c0"] == pytest.approx(1.055 * 0.25 ** (1 / 2.4) - 0.055) and "role scene_linear lin_rec709" in c.printed
    c.run("--dup --flipdiff:hdr=0".split())
    assert len(c.stack) == 1 and first(c)["c0"] == 0
    with pytest.raises(ValueError, match="unknown look"):
        c.run("--pattern constant:color=1 2x2 3 --ociolook nothing".split())
