import numpy as np

from rastrel.__main__ import main
from rastrel.kernels import paint
from rastrel.plans import report


def test_texts():
    assert report.bar(0.5, 4) == "##.." and report.bar(2, 3) == "###"
    assert report.shortened("abcdef", 6) == "abcdef" and report.shortened("éééé", 6) == "é..."
    text = report.metrics_text({"match_pct": 99, "mean_de": 1, "p95_de": 2, "max_de": 3, "rmse": 1, "psnr": 40}, 3.5)
    assert "deltaE 3.5" in text
    assert report.suggested_key(np.zeros((2, 2, 4))) == "#ffffff"


def test_suite_has_eleven_images_and_a_summary(spark, tmp_path):
    from rastrel.plans import queries
    from rastrel.sources import scenes

    assert main(["gen", str(tmp_path)]) == 0 and len(list(tmp_path.glob("*.png"))) == 11 and len(list(tmp_path.glob("*.svg"))) == 8
    *rows, last = queries.QUERIES["bench_suite"](spark, "").collect()
    assert [r["name"] for r in rows] == "hard-rects aa-circle slants junctions star rings logo pixel-art noisy-shapes alpha gradient".split()
    assert {r["name"] for r in rows if r["ceiling_pct"] is None and r["gap"] is None} == {"pixel-art", "noisy-shapes", "gradient"}
    assert last["name"] == "summary" and last["cases"] == 11 and last["points"] == sum(r["points"] for r in rows)
    assert last["at_target"] == sum(r["match_pct"] >= 99 for r in rows) and abs(last["match_pct"] - np.mean([r["match_pct"] for r in rows])) < 2e-3
    assert last["worst_gap"] == max(r["gap"] for r in rows if r["gap"] is not None)
    noisy = scenes.noisy_shapes()
    assert noisy.shape == (140, 180, 4) and abs(noisy[60, 50, :3] - np.array((40, 40, 120)) / 255).max() < 0.03
    assert sum(r["points"] > 0 for r in queries.QUERIES["trace_scenes"](spark, "").collect()) == 11


def test_commands(spark, tmp_path, capsys):
    image = np.ones((20, 24, 4))
    image[4:12, 5:18, :3] = (0.8, 0.2, 0.1)
    (tmp_path / "a.png").write_bytes(paint.png(image))
    assert main(["trace", str(tmp_path / "a.png"), "-o", str(tmp_path / "a.svg"), "--preset", "logo", "--recolor"]) == 0
    assert main(["score", str(tmp_path / "a.png"), str(tmp_path / "a.svg")]) == 0
    assert "match      100.00 %" in capsys.readouterr().out
    assert main(["inspect", str(tmp_path / "a.png")]) == 0
    assert '"unique_colors": 2' in capsys.readouterr().out
    assert main(["gen", str(tmp_path / "scenes")]) == 0 and (tmp_path / "scenes" / "logo.png").exists()
