import math

from surveylens.functions import special as S


def test_f_tail_fixture():
    assert math.isclose(S.f_sf(2.5, 4, 1495), 0.040878754280836094, rel_tol=1e-9)


def test_t_quantile_fixture():
    assert math.isclose(S.t_ppf(0.975, 100), 1.9839715183714557, rel_tol=1e-8)


def test_t_two_sided():
    # P(|T_1| > 1) = 0.5 for the Cauchy distribution
    assert math.isclose(S.t_two_sided_p(1.0, 1), 0.5, rel_tol=1e-10)


def test_f_edge_cases():
    assert S.f_sf(None, 1, 2) is None
    assert S.f_sf(0.0, 1, 2) == 1.0
    assert S.f_sf(float("inf"), 1, 2) == 0.0


def _f_pdf(x, d1, d2):
    lg = math.lgamma
    return math.exp(lg((d1 + d2) / 2) - lg(d1 / 2) - lg(d2 / 2) + (d1 / 2) * math.log(d1 / d2)
                    + (d1 / 2 - 1) * math.log(x) - ((d1 + d2) / 2) * math.log1p(d1 * x / d2))


def test_f_tail_against_numeric_integration():
    # brute force: Simpson's rule on the density up to a far cut-off
    for f, d1, d2 in [(1.5, 3, 20), (2.5, 4, 60), (0.7, 7, 12)]:
        hi, n = 400.0, 200_000
        h = (hi - f) / n
        total = _f_pdf(f, d1, d2) + _f_pdf(hi, d1, d2)
        for i in range(1, n):
            total += (4 if i % 2 else 2) * _f_pdf(f + i * h, d1, d2)
        assert math.isclose(S.f_sf(f, d1, d2), total * h / 3, rel_tol=1e-5, abs_tol=1e-7)
