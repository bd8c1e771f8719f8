from __future__ import annotations

from orbitree.llm.quality import quality


def test_pages_that_are_mostly_furniture_count_as_different(spark):
    menu = "\n".join(" ".join(f"menu{i}n{j}" for j in range(40)) for i in range(10))
    rows = [(i, f"{menu}\n{' '.join(f'{w}{chr(97 + i % 26)}{chr(97 + i // 26)}' for w in ('own', 'page', 'body'))}", "shop") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for j in range(60)), "shop") for i in range(500)]
    verdict = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(verdict[i].kept for i in range(300))
    assert all(verdict[1000 + i].kept and verdict[1000 + i].removed_chars == 0 for i in range(500))


def test_copies_count_once_in_the_host_as_well(spark):
    line = " ".join(f"menu{j}" for j in range(30))
    rows = [(i, f"{line}\n{' '.join(f'{chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + i)}' for j in range(60))}", "h") for i in range(25)]
    rows += [(100 + i, " ".join(f"copy{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)), "h") for i in range(2000)]
    verdict = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(verdict[i].removed_chars > 0 and verdict[i].kept for i in range(25))
