from __future__ import annotations

import pytest

from lattica.units import Unit, UnitError, alias, remove_alias


def test_algebra():
    assert Unit("m") * Unit("m") == Unit("m^2")
    assert Unit("m") / Unit("s") == Unit("m/s")
    assert Unit("m^2") ** 0.5 == Unit("m")
    assert Unit("N") == Unit("kg*m/s^2")
    assert Unit("counts") != Unit("one")


def test_factors():
    assert Unit("mm").factor_to(Unit("m")) == pytest.approx(1e-3)
    assert Unit("h").factor_to(Unit("s")) == 3600
    with pytest.raises(UnitError):
        Unit("m").factor_to(Unit("s"))


def test_alias():
    alias(speed="m/s")
    assert Unit("speed") == Unit("m/s")
    remove_alias("speed")
    with pytest.raises(UnitError):
        Unit("speed")
