from __future__ import annotations

from spanscope.__main__ import main


def test_list(capsys):
    assert main(["--list"]) == 0 and "c4_ecl_beta" in capsys.readouterr().out


def test_run(spark, tmp_path, capsys):
    assert main(["a14", "--out", f"file://{tmp_path}", "--format", "latex"]) == 0
    assert main(["a14", "f6", "--out", f"file://{tmp_path}/c"]) == 0
    assert "2 of 2 done" in capsys.readouterr().out
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c/a14_taxonomy").count() == 12
