"""The problem catalogue against the ground truth written down in FIXTURES.md."""

import re

from compare import ROOT
from opsframe.functions.problems import catalogue_rows


def _table():
    with open(f"{ROOT}/FIXTURES.md") as file:
        section = file.read().split("## 6. Problem ground truth")[1].split("Localization cases")[0]
    return [[cell.strip() for cell in line.strip("|").split("|")] for line in section.splitlines() if line.startswith("|")][2:]


def test_numbered_faults_have_the_truth_written_down():
    """Families whose row names the fault by its id: component by number, level and type."""
    rows, checked = catalogue_rows(), 0
    for family, components, kinds, _ in _table():
        fault = re.match(r"[\w-]+", family).group(0)
        mine = [r for r in rows if r[1] == fault]
        if fault == "noop" or not mine or "," in family.split("(")[0]:
            continue
        names = [c.strip() for c in components.split(",")]
        level, _, kind = kinds.partition(" / ")
        for problem_id, _, task, number, _, _, expected, component, system_level, fault_type in mine:
            assert expected == "Yes"
            if not components.startswith("—") and task != "detection":
                assert component == names[(number or 1) - 1], problem_id
            if task == "analysis" and kinds != "—":
                assert (system_level, fault_type) == (level, kind), problem_id
            checked += 1
    assert checked > 40


def test_counts_by_task_and_ids():
    rows = catalogue_rows()
    count = lambda task: sum(r[2] == task for r in rows)
    assert [count(t) for t in ("detection", "localization", "analysis", "mitigation")] == [34, 28, 13, 14]
    assert len({r[0] for r in rows}) == 89
    assert all((r[6] == "No") == r[0].startswith("noop_") for r in rows)
