import datetime as dt

import numpy as np
import pytest

from gridcast.models import response

SCHEMA = "zone string, ds timestamp_ntz, u double, y double"
START = dt.datetime(2022, 1, 1)


def series(order, n, seed, noise=0.0, about=(0.0, 0.0)):
    """An output that follows a slowly varying input around an operating point, measured with noise; and its constants."""
    rng = np.random.default_rng(seed)
    u = np.convolve(rng.normal(size=n + 5), np.ones(6) / 6, "valid")[:n] * 3
    y = np.zeros(n)
    if order == 1:
        k, tau = 2.5, 9.49
        a = np.exp(-1 / tau)
        for t in range(1, n):
            y[t] = a * y[t - 1] + k * (1 - a) * u[t - 1]
        want = {"k": k, "tau": tau}
    else:
        k, wn, zeta = 1.5, 0.4, 0.3
        poles = wn * (-zeta + 1j * np.sqrt(1 - zeta ** 2))
        a1, a2 = 2 * np.exp(poles).real, -abs(np.exp(poles)) ** 2
        gain = k * (1 - a1 - a2)
        for t in range(2, n):
            y[t] = a1 * y[t - 1] + a2 * y[t - 2] + gain * (0.6 * u[t - 1] + 0.4 * u[t - 2])
        want = {"k": k, "wn": wn, "zeta": zeta}
    y = y + rng.normal(size=n) * noise * y.std()
    return [(START + dt.timedelta(hours=i), float(a + about[0]), float(b + about[1])) for i, (a, b) in enumerate(zip(u, y))], want


@pytest.mark.parametrize("order", [1, 2])
def test_constant_offsets_do_not_matter(frame, order):
    rows, want = series(order, 400, 1, about=(55.0, 1e7))
    still = [("FLAT", t, 1.0, 5.0) for t, _, _ in rows[:30]]
    got = {r.zone: r for r in response.centred(frame([("AE", *r) for r in rows] + still, SCHEMA), "u", "y", order, block_rows=64).collect()}
    for name, value in want.items():
        assert got["AE"][name] == pytest.approx(value, rel=1e-4)
        assert got["FLAT"][name] is None
    r = got["AE"]
    # At rest the fitted response stays at its operating point.
    assert r.offset + sum(r.a) * 1e7 + sum(r.b) * 55 == pytest.approx(1e7, rel=1e-6)


@pytest.mark.parametrize("order", [1, 2])
def test_noise_is_not_taken_for_a_faster_response(frame, order):
    rows, want = series(order, 20_000, 2, noise=0.2, about=(55.0, 1e6))
    df = frame([("AE", *r) for r in rows], SCHEMA)
    got, plain = response.refined(df, "u", "y", order).first(), response.centred(df, "u", "y", order).first()
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=0.02)
    worst = max(abs((plain[name] or 0.0) / value - 1) for name, value in want.items())
    assert worst > 0.1


def test_odd_series(frame):
    assert response.refined(frame([], SCHEMA), "u", "y").count() == 0
    short = [("AE", START + dt.timedelta(hours=i), float(i % 3), float(i % 2)) for i in range(20)]
    assert response.refined(frame(short, SCHEMA), "u", "y", lags=24).count() == 0
    growing = [("AE", START + dt.timedelta(hours=i), float(i % 3), float(1.2 ** i)) for i in range(60)]
    row = response.centred(frame(growing, SCHEMA), "u", "y").first()
    assert row.a[0] == pytest.approx(1.2, rel=1e-3) and row.tau is None and row.k is None
    with pytest.raises(ValueError, match="first or second"):
        response.refined(frame(short, SCHEMA), "u", "y", order=3)
