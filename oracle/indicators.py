"""Oracle SQL of every indicator at its default parameters."""

from __future__ import annotations

import math

from oracle.series import Q


def _forms() -> dict:
    f: dict = {}

    def d(fn):
        f[fn.__name__.rstrip("_")] = fn
        return fn

    def one(name, build):
        f[name] = lambda q: {"value": build(q)}

    def c(text):
        return lambda q: q.add(text)

    def dema(q):
        a = q.ema("close", 20)
        return q.add(f"2 * {a} - {q.ema(a, 20)}")

    def tema(q):
        a = q.ema("close", 20)
        b = q.ema(a, 20)
        return q.add(f"3 * {a} - 3 * {b} + {q.ema(b, 20)}")

    def hma(q):
        a, b = q.wma("close", 10), q.wma("close", 20)
        return q.wma(q.add(f"2 * {a} - {b}"), 4)

    def kama(q):
        change, path = q.add(f"abs({q.diff('close', 10)})"), q.sum(q.add(f"abs({q.diff('close')})"), 10)
        sc = q.add(f"pow(CASE WHEN {path} > 0 THEN {change} / {path} WHEN {path} = 0 THEN 0 END * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2)")
        first = q.run("count", sc)
        prior = q.lag("close")
        fold = q.fold(
            {"c": "close", "w": sc, "f": f"CASE WHEN {first} = 1 THEN 1 ELSE 0 END", "p": prior},
            {"y": f"{prior} + {sc} * (close - {prior})"},
            {"y": "CASE WHEN z.w IS NULL THEN a.y ELSE a.y + z.w * (z.c - a.y) END"},
            f"{sc} IS NOT NULL",
        )
        return q.add(f"CASE WHEN {sc} IS NOT NULL THEN {fold}.y END")

    def t3(q):
        e = ["close"]
        for _ in range(6):
            e.append(q.ema(e[-1], 5))
        v = 0.7
        return q.add(f"{-v**3!r} * {e[6]} + {3*v**2+3*v**3!r} * {e[5]} + {-6*v**2-3*v-3*v**3!r} * {e[4]} + {1+3*v+v**3+3*v**2!r} * {e[3]}")

    def mcginley(q):
        fold = q.fold({"c": "close"}, {"y": "close"}, {"y": "CASE WHEN a.y > 0 THEN a.y + (z.c - a.y) / (0.6 * 14 * pow(z.c / a.y, 4)) ELSE z.c END"})
        return q.add(f"CASE WHEN rn >= 14 THEN {fold}.y END")

    one("sma", lambda q: q.mean("close", 20))
    one("ema", lambda q: q.ema("close", 20))
    one("wma", lambda q: q.wma("close", 20))
    one("dema", dema)
    one("tema", tema)
    one("hma", hma)
    one("kama", kama)
    one("vwma", lambda q: q.add(f"{q.sum(q.add('close * volume'), 20)} / nullif({q.sum('volume', 20)}, 0)"))
    one("zlema", lambda q: q.ema(q.add(f"2 * close - {q.lag('close', 9)}"), 20))
    one("t3", t3)
    one("smma", lambda q: q.wilder("close", 14))
    one("trima", lambda q: q.mean(q.mean("close", 10), 11))
    one("mcginley", mcginley)

    def rvwap(q, n=20):
        return q.add(f"{q.sum(q.add(f'{q.tp()} * volume'), n)} / nullif({q.sum('volume', n)}, 0)")

    one("rolling_vwap", rvwap)
    one("vwap", lambda q: q.add(f"{q.run('sum', q.add(f'{q.tp()} * volume'))} / nullif({q.run('sum', 'volume')}, 0)"))

    @d
    def bollinger(q):
        m, s = q.mean("close", 20), q.std("close", 20, 0)
        return {"lower": q.add(f"{m} - 2 * {s}"), "middle": m, "upper": q.add(f"{m} + 2 * {s}")}

    def pctb(q):
        m, s = q.mean("close", 20), q.std("close", 20, 0)
        return q.add(f"CASE WHEN 2 * {s} > 1e-12 * abs({m}) THEN (close - {m} + 2 * {s}) / (4 * {s}) END")

    one("bollinger_pctb", pctb)

    @d
    def keltner(q):
        m, a = q.ema("close", 20), q.wilder(q.tr(), 10)
        return {"lower": q.add(f"{m} - 2 * {a}"), "middle": m, "upper": q.add(f"{m} + 2 * {a}")}

    @d
    def donchian(q):
        h, l = q.max("high", 20), q.min("low", 20)
        return {"lower": l, "middle": q.add(f"({h} + {l}) / 2"), "upper": h}

    def psar(q):
        h1, l1, h2, l2, c1 = q.lag("high"), q.lag("low"), q.lag("high", 2), q.lag("low", 2), q.lag("close")
        fields = {"h": "high", "l": "low", "c": "close", "h1": h1, "l1": l1, "h2": h2, "l2": l2, "c1": c1, "n": "rn"}
        state = {"up": "1", "sar": "0", "ep": "0", "af": "0.02"}
        boot_up = "(z.c >= z.c1)"
        raw = "(a.sar + a.af * (a.ep - a.sar))"
        nxt_up, nxt_dn = f"least({raw}, z.l1, z.l2)", f"greatest({raw}, z.h1, z.h2)"
        step = {
            "up": f"CASE WHEN z.n = 2 THEN CASE WHEN {boot_up} THEN 1 ELSE 0 END WHEN a.up = 1 THEN CASE WHEN z.l < {nxt_up} THEN 0 ELSE 1 END ELSE CASE WHEN z.h > {nxt_dn} THEN 1 ELSE 0 END END",
            "sar": f"CASE WHEN z.n = 2 THEN CASE WHEN {boot_up} THEN z.l1 ELSE z.h1 END WHEN a.up = 1 THEN CASE WHEN z.l < {nxt_up} THEN a.ep ELSE {nxt_up} END ELSE CASE WHEN z.h > {nxt_dn} THEN a.ep ELSE {nxt_dn} END END",
            "ep": f"CASE WHEN z.n = 2 THEN CASE WHEN {boot_up} THEN greatest(z.h1, z.h) ELSE least(z.l1, z.l) END WHEN a.up = 1 THEN CASE WHEN z.l < {nxt_up} THEN z.l ELSE greatest(a.ep, z.h) END ELSE CASE WHEN z.h > {nxt_dn} THEN z.h ELSE least(a.ep, z.l) END END",
            "af": f"CASE WHEN z.n = 2 THEN 0.02 WHEN a.up = 1 THEN CASE WHEN z.l < {nxt_up} THEN 0.02 WHEN z.h > a.ep THEN least(a.af + 0.02, 0.2) ELSE a.af END ELSE CASE WHEN z.h > {nxt_dn} THEN 0.02 WHEN z.l < a.ep THEN least(a.af + 0.02, 0.2) ELSE a.af END END",
        }
        return q.add(f"CASE WHEN rn > 1 THEN {q.fold(fields, state, step)}.sar END")

    one("psar", psar)

    def strend(q):
        a = q.wilder(q.tr(), 10)
        m, c1 = q.mid(), q.lag("close")
        fields = {"c": "close", "c1": c1, "u": f"{m} + 3 * {a}", "l": f"{m} - 3 * {a}"}
        state = {"fu": f"{m} + 3 * {a}", "fl": f"{m} - 3 * {a}", "dir": f"CASE WHEN close >= {m} THEN 1 ELSE -1 END"}
        fu = "(CASE WHEN z.u < a.fu OR z.c1 > a.fu THEN z.u ELSE a.fu END)"
        fl = "(CASE WHEN z.l > a.fl OR z.c1 < a.fl THEN z.l ELSE a.fl END)"
        step = {"fu": fu, "fl": fl, "dir": f"CASE WHEN a.dir = -1 THEN CASE WHEN z.c > {fu} THEN 1 ELSE -1 END ELSE CASE WHEN z.c < {fl} THEN -1 ELSE 1 END END"}
        return a, q.fold(fields, state, step, f"{a} IS NOT NULL")

    def supertrend(q):
        a, s = strend(q)
        return q.add(f"CASE WHEN {a} IS NOT NULL THEN CASE WHEN {s}.dir = 1 THEN {s}.fl ELSE {s}.fu END END")

    def sdir(q):
        a, s = strend(q)
        return q.add(f"CASE WHEN {a} IS NOT NULL THEN {s}.dir END")

    one("supertrend", supertrend)
    one("supertrend_direction", sdir)
    one("linreg", lambda q: q.regr("close", 20)[1])
    one("linreg_slope", lambda q: q.regr("close", 20)[0])
    one("linreg_r2", lambda q: q.regr("close", 20)[2])

    @d
    def ichimoku(q):
        a, b, w = (q.add(f"({q.max('high', n)} + {q.min('low', n)}) / 2") for n in (9, 26, 52))
        return {"tenkan": a, "kijun": b, "senkou_a": q.add(f"({a} + {b}) / 2"), "senkou_b": w}

    @d
    def adx(q):
        up, dn = q.diff("high"), q.add(f"{q.lag('low')} - low")
        sm = q.wilder(q.tr1(), 14)
        p, m = (q.add(f"100 * {q.wilder(q.add(f'CASE WHEN {a} IS NOT NULL THEN CASE WHEN {a} > {b} AND {a} > 0 THEN {a} ELSE 0 END END'), 14)} / nullif({sm}, 0)") for a, b in ((up, dn), (dn, up)))
        dx = q.add(f"CASE WHEN {p} + {m} = 0 THEN 0 ELSE 100 * abs({p} - {m}) / ({p} + {m}) END")
        return {"adx": q.wilder(dx, 14), "plus_di": p, "minus_di": m}

    @d
    def aroon(q):
        hi, lo = q.agg("list", "high", 26), q.agg("list", "low", 26)
        up = q.add(f"100.0 * (25 - (list_position(list_reverse({hi}), list_max({hi})) - 1)) / 25")
        dn = q.add(f"100.0 * (25 - (list_position(list_reverse({lo}), list_min({lo})) - 1)) / 25")
        return {"up": up, "down": dn, "osc": q.add(f"{up} - {dn}")}

    @d
    def vortex(q):
        t = q.sum(q.tr1(), 14)
        return {
            "plus": q.add(f"{q.sum(q.add(f'abs(high - {q.lag('low')})'), 14)} / nullif({t}, 0)"),
            "minus": q.add(f"{q.sum(q.add(f'abs(low - {q.lag('high')})'), 14)} / nullif({t}, 0)"),
        }

    one("ma_distance", lambda q: q.pct("close", q.mean("close", 20)))
    one("ema_distance", lambda q: q.pct("close", q.ema("close", 20)))

    @d
    def envelope(q):
        m = q.mean("close", 20)
        return {"lower": q.add(f"{m} * 0.975"), "middle": m, "upper": q.add(f"{m} * 1.025")}

    @d
    def chandelier_exit(q):
        a = q.wilder(q.tr(), 22)
        return {"long": q.add(f"{q.max('high', 22)} - 3 * {a}"), "short": q.add(f"{q.min('low', 22)} + 3 * {a}")}

    one("median_price_ma", lambda q: q.mean(q.mid(), 20))

    # momentum
    one("rsi", lambda q: q.rsi(14))

    def kd(q, raw):
        k = q.clamp(q.mean(raw, 3), 0, 100)
        return {"k": k, "d": q.clamp(q.mean(k, 3), 0, 100)}

    f["stochastic"] = lambda q: kd(q, q.stoch("close", q.max("high", 14), q.min("low", 14)))

    @d
    def stoch_rsi(q):
        r = q.rsi(14)
        return kd(q, q.stoch(r, q.max(r, 14), q.min(r, 14)))

    def lines(q, line, names):
        s = q.ema(line, 9)
        return dict(zip(names, (line, s, q.add(f"{line} - {s}"))))

    f["macd"] = lambda q: lines(q, q.add(f"{q.ema('close', 12)} - {q.ema('close', 26)}"), ("macd", "signal", "hist"))
    f["ppo"] = lambda q: lines(q, q.add(f"100 * ({q.ema('close', 12)} - {q.ema('close', 26)}) / nullif({q.ema('close', 26)}, 0)"), ("ppo", "signal", "hist"))
    one("roc", lambda q: q.roc("close", 12))
    one("momentum", lambda q: q.diff("close", 10))

    def cci(q):
        t = q.tp()
        m, l = q.mean(t, 20), q.agg("list", t, 20)
        dev = q.add(f"list_sum(list_transform({l}, lambda v: abs(v - {m}))) / 20")
        return q.add(f"CASE WHEN {dev} > 1e-12 * abs({m}) THEN ({t} - {m}) / (0.015 * {dev}) END")

    one("cci", cci)
    one("williams_r", lambda q: q.clamp(q.add(f"{q.stoch('close', q.max('high', 14), q.min('low', 14))} - 100"), -100, 0))

    def tsi(q):
        m = q.diff("close")
        return q.add(f"100 * {q.ema(q.ema(m, 25), 13)} / nullif({q.ema(q.ema(q.add(f'abs({m})'), 25), 13)}, 0)")

    one("tsi", tsi)

    def uo(q):
        p = q.lag("close")
        bp = q.add(f"CASE WHEN {p} IS NOT NULL THEN close - least(low, {p}) END")
        tr = q.add(f"CASE WHEN {p} IS NOT NULL THEN greatest(high, {p}) - least(low, {p}) END")
        a, b, cc = (q.add(f"{q.sum(bp, n)} / nullif({q.sum(tr, n)}, 0)") for n in (7, 14, 28))
        return q.clamp(q.add(f"100 * (4 * {a} + 2 * {b} + {cc}) / 7"), 0, 100)

    one("ultimate_oscillator", uo)

    def ao(q):
        return q.add(f"{q.mean(q.mid(), 5)} - {q.mean(q.mid(), 34)}")

    one("awesome_oscillator", ao)
    one("accelerator_oscillator", lambda q: q.add(f"{ao(q)} - {q.mean(ao(q), 5)}"))

    def cmo(q):
        x = q.diff("close")
        u, dn = (q.sum(q.add(f"CASE WHEN {x} IS NOT NULL THEN greatest({s}{x}, 0) END"), 14) for s in ("", "-"))
        return q.add(f"CASE WHEN {u} + {dn} = 0 THEN 0 ELSE 100 * ({u} - {dn}) / ({u} + {dn}) END")

    one("cmo", cmo)
    one("trix", lambda q: q.roc(q.ema(q.ema(q.ema("close", 15), 15), 15), 1))
    one("apo", lambda q: q.add(f"{q.ema('close', 12)} - {q.ema('close', 26)}"))
    one("dpo", lambda q: q.add(f"{q.lag('close', 11)} - {q.mean('close', 20)}"))

    @d
    def fisher(q):
        m = q.mid()
        hi, lo = q.max(m, 10), q.min(m, 10)
        x0 = f"least(0.999, greatest(-0.999, 0.66 * (({m} - {lo}) / nullif({hi} - {lo}, 0) - 0.5)))"
        x = "least(0.999, greatest(-0.999, 0.66 * (z.u - 0.5) + 0.67 * a.x))"
        live = f"{hi} > {lo}"
        fold = q.fold(
            {"u": f"({m} - {lo}) / nullif({hi} - {lo}, 0)"},
            {"x": x0, "f": f"0.5 * ln((1 + {x0}) / (1 - {x0}))", "s": "NULL"},
            {"x": x, "f": f"0.5 * ln((1 + {x}) / (1 - {x})) + 0.5 * a.f", "s": "a.f"},
            live,
        )
        return {"fisher": q.add(f"CASE WHEN {live} THEN {fold}.f END"), "signal": q.add(f"CASE WHEN {live} THEN {fold}.s END")}

    @d
    def connors_rsi(q):
        s = q.add(f"coalesce(sign({q.diff('close')}), 0)")
        fold = q.fold({"s": s}, {"y": s}, {"y": "CASE WHEN z.s = 0 THEN 0 WHEN a.y * z.s > 0 THEN a.y + z.s ELSE z.s END"})
        streak = q.add(f"{fold}.y")
        a, b, r = q.rsi(3), q.strength(q.diff(streak), 2), q.rank(q.roc("close", 1), 100)
        return {"crsi": q.add(f"({a} + {b} + {r}) / 3"), "rsi": a, "streak_rsi": b, "percent_rank": r}

    @d
    def kst(q):
        a, b, cc, e = (q.mean(q.roc("close", r), n) for r, n in ((10, 10), (15, 10), (20, 10), (30, 15)))
        k = q.add(f"{a} + 2 * {b} + 3 * {cc} + 4 * {e}")
        return {"kst": k, "signal": q.mean(k, 9)}

    one("coppock", lambda q: q.wma(q.add(f"{q.roc('close', 14)} + {q.roc('close', 11)}"), 10))

    def sw(q, x):
        return q.add(f"({x} + 2 * {q.lag(x, 1)} + 2 * {q.lag(x, 2)} + {q.lag(x, 3)}) / 6")

    @d
    def rvi(q):
        r = q.add(f"{q.mean(sw(q, q.add('close - open')), 10)} / nullif({q.mean(sw(q, q.add('high - low')), 10)}, 0)")
        return {"rvi": r, "signal": sw(q, r)}

    one("bop", lambda q: q.mean(q.add("CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) END"), 14))

    @d
    def elder_ray(q):
        e = q.ema("close", 13)
        return {"bull": q.add(f"high - {e}"), "bear": q.add(f"low - {e}")}

    one("cfo", lambda q: q.add(f"100 * (close - {q.regr('close', 14)[1]}) / close"))
    one("qstick", lambda q: q.mean(q.add("close - open"), 8))
    one("rmi", lambda q: q.strength(q.diff("close", 5), 14))

    # volatility
    one("true_range", lambda q: q.tr())
    one("atr", lambda q: q.mean(q.tr(), 14))
    one("atr_wilder", lambda q: q.wilder(q.tr(), 14))
    one("natr", lambda q: q.add(f"100 * {q.wilder(q.tr(), 14)} / close"))
    one("stdev_returns", lambda q: q.std(q.add(f"100 * {q.change('close')}"), 20, 1))
    year = f"sqrt(252) * 100"

    def ann(q, v):
        return q.add(f"CASE WHEN {v} >= 0 THEN sqrt({v} * 252) * 100 END")

    one("hist_vol", lambda q: q.add(f"{q.std(q.logc('close'), 20, 1)} * {year}"))
    one("parkinson", lambda q: ann(q, q.mean(q.add(f"pow(ln(high / low), 2) / {4 * math.log(2)!r}"), 20)))
    one("garman_klass", lambda q: ann(q, q.mean(q.add(f"0.5 * pow(ln(high / low), 2) - {2 * math.log(2) - 1!r} * pow(ln(close / open), 2)"), 20)))

    def rs(q):
        return q.add("ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)")

    one("rogers_satchell", lambda q: ann(q, q.mean(rs(q), 20)))

    def yz(q):
        k = 0.34 / (1.34 + 21 / 19)
        o = q.var(q.add(f"ln(open / {q.lag('close')})"), 20, 1)
        i = q.var(q.add("ln(close / open)"), 20, 1)
        return ann(q, q.add(f"{o} + {k!r} * {i} + {1 - k!r} * {q.mean(rs(q), 20)}"))

    one("yang_zhang", yz)
    one("ewma_vol", lambda q: ann(q, q.ewm(q.add(f"pow({q.logc('close')}, 2)"), 1 - 0.94, 20)))
    one("chaikin_volatility", lambda q: q.roc(q.ema(q.add("high - low"), 10), 10))

    def ulcer(q):
        p = q.max("close", 14)
        return q.add(f"sqrt({q.mean(q.add(f'pow(100 * (close - {p}) / {p}, 2)'), 14)})")

    one("ulcer_index", ulcer)

    def dw(q):
        h, l = q.max("high", 20), q.min("low", 20)
        return q.add(f"200 * ({h} - {l}) / nullif({h} + {l}, 0)")

    one("donchian_width", dw)
    one("bollinger_bandwidth", lambda q: q.add(f"400 * {q.std('close', 20, 0)} / nullif({q.mean('close', 20)}, 0)"))

    def chop(q):
        s, r = q.sum(q.tr(), 14), q.add(f"{q.max('high', 14)} - {q.min('low', 14)}")
        return q.clamp(q.add(f"CASE WHEN {r} > 0 AND {s} > 0 THEN 100 * log10({s} / {r}) / log10(14) END"), 0, 100)

    one("choppiness", chop)
    one("range_atr", lambda q: q.add(f"(high - low) / nullif({q.wilder(q.tr(), 14)}, 0)"))

    def mass(q):
        a = q.ema(q.add("high - low"), 9)
        return q.sum(q.add(f"{a} / nullif({q.ema(a, 9)}, 0)"), 25)

    one("mass_index", mass)

    # volume
    one("obv", lambda q: q.add(f"coalesce({q.run('sum', q.add(f'sign(close - {q.lag('close')}) * volume'))}, 0)"))

    def adl(q):
        return q.run("sum", q.add(f"{q.clv()} * volume"))

    one("ad_line", adl)
    one("cmf", lambda q: q.clamp(q.add(f"{q.sum(q.add(f'{q.clv()} * volume'), 20)} / nullif({q.sum('volume', 20)}, 0)"), -1, 1))
    one("chaikin_osc", lambda q: q.add(f"{q.ema(adl(q), 3)} - {q.ema(adl(q), 10)}"))

    def mfi(q):
        x = q.diff(q.tp())
        p = q.sum(q.add(f"CASE WHEN {x} > 0 THEN {q.tp()} * volume WHEN {x} <= 0 THEN 0 END"), 14)
        n = q.sum(q.add(f"CASE WHEN {x} < 0 THEN {q.tp()} * volume WHEN {x} >= 0 THEN 0 END"), 14)
        return q.add(f"CASE WHEN {p} IS NULL THEN NULL WHEN {n} = 0 THEN CASE WHEN {p} > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + {p} / {n}) END")

    one("mfi", mfi)
    one("force_index", lambda q: q.ema(q.add(f"volume * {q.diff('close')}"), 13))
    one("ease_of_movement", lambda q: q.mean(q.add(f"{q.diff(q.mid())} * (high - low) * 1000000 / nullif(volume, 0)"), 14))
    one("volume_sma", lambda q: q.mean("volume", 20))
    one("volume_roc", lambda q: q.roc("volume", 14))
    one("relative_volume", lambda q: q.add(f"volume / nullif({q.mean('volume', 20)}, 0)"))

    def z(q, x):
        m, s = q.mean(x, 20), q.std(x, 20, 1)
        return q.add(f"CASE WHEN {s} > 1e-12 * abs({m}) THEN ({x} - {m}) / {s} END")

    one("volume_zscore", lambda q: z(q, "volume"))
    one("volume_oscillator", lambda q: q.pct(q.ema("volume", 5), q.ema("volume", 10)))

    @d
    def klinger(q):
        h, r = q.add("high + low + close"), q.add("high - low")
        t = q.add(f"CASE WHEN {q.lag(h)} IS NULL THEN NULL WHEN {h} > {q.lag(h)} THEN 1 ELSE -1 END")
        flip = q.add(f"CASE WHEN {t} IS NOT NULL AND ({q.lag(t)} IS NULL OR {t} <> {q.lag(t)}) THEN 1 ELSE 0 END")
        isl = q.run("sum", flip)
        part = f"OVER (PARTITION BY symbol, {isl} ORDER BY ts ROWS UNBOUNDED PRECEDING)"
        cm = q.add(f"CASE WHEN {t} IS NOT NULL THEN sum({r} + CASE WHEN {flip} = 1 THEN {q.lag(r)} ELSE 0 END) {part} END")
        fo = q.add(f"CASE WHEN {cm} = 0 THEN 0 ELSE volume * abs(2 * ({r} / {cm} - 1)) * {t} * 100 END")
        k = q.add(f"{q.ema(fo, 34)} - {q.ema(fo, 55)}")
        return {"kvo": k, "signal": q.ema(k, 13)}

    one("pvt", lambda q: q.add(f"coalesce({q.run('sum', q.add(f'volume * {q.change('close')}'))}, 0)"))

    def vi(q, op):
        x = q.add(f"CASE WHEN volume {op} {q.lag('volume')} THEN close / {q.lag('close')} END")
        return q.add(f"1000 * coalesce({q.run('product', x)}, 1)")

    one("nvi", lambda q: vi(q, "<"))
    one("pvi", lambda q: vi(q, ">"))
    one("vwap_distance", lambda q: q.pct("close", rvwap(q)))
    one("dollar_volume", c("close * volume"))

    # statistics
    one("simple_return", lambda q: q.roc("close", 1))
    one("log_return", lambda q: q.add(f"100 * {q.logc('close')}"))
    one("rolling_return", lambda q: q.roc("close", 20))
    one("mean_return", lambda q: q.mean(q.roc("close", 1), 20))
    one("zscore", lambda q: z(q, "close"))
    one("percent_rank", lambda q: q.rank("close", 100))

    def moment(q, k):
        x = q.change("close")
        m, l = q.mean(x, 60), q.agg("list", x, 60)
        m2 = q.add(f"list_sum(list_transform({l}, lambda v: pow(v - {m}, 2))) / 60")
        mk = q.add(f"list_sum(list_transform({l}, lambda v: pow(v - {m}, {k}))) / 60")
        n = 60
        if k == 3:
            return q.add(f"{math.sqrt(n * (n - 1)) / (n - 2)!r} * {mk} / pow({m2}, 1.5)")
        return q.add(f"({n * n - 1} * ({mk} / ({m2} * {m2})) - {3 * (n - 1) ** 2}) / {(n - 2) * (n - 3)}")

    one("skew", lambda q: moment(q, 3))
    one("kurtosis", lambda q: moment(q, 4))

    def ratio(q, spread):
        m = q.mean(q.change("close"), 60)
        return q.add(f"CASE WHEN {spread} > 1e-12 * abs({m}) THEN {m} / {spread} END * sqrt(252)")

    one("sharpe", lambda q: ratio(q, q.std(q.change("close"), 60, 1)))
    one("sortino", lambda q: ratio(q, q.add(f"sqrt({q.mean(q.add(f'CASE WHEN {q.change('close')} < 0 THEN pow({q.change('close')}, 2) WHEN {q.change('close')} >= 0 THEN 0 END'), 60)})")))
    one("drawdown", lambda q: q.pct("close", q.run("max", "close")))

    def mdd(q):
        l = q.agg("list", "close", 60)
        peaks = q.add(f"list_transform({l}, lambda v, i: v / list_max({l}[1:i]) - 1)")
        return q.add(f"100 * list_min({peaks})")

    one("max_drawdown", mdd)
    one("highest_high", lambda q: q.max("high", 20))
    one("lowest_low", lambda q: q.min("low", 20))
    one("distance_from_high", lambda q: q.pct("close", q.max("high", 20)))
    one("distance_from_low", lambda q: q.pct("close", q.min("low", 20)))

    def acf(q):
        r = q.change("close")
        p = q.lag(r)
        w = q.frame(30)
        return q.clamp(q.add(f"CASE WHEN count({p}) {w} = 30 THEN corr({r}, {p}) {w} END"), -1, 1)

    one("autocorrelation", acf)
    one("up_bar_ratio", lambda q: q.clamp(q.add(f"100 * {q.mean(q.add(f'CASE WHEN {q.change('close')} > 0 THEN 1.0 WHEN {q.change('close')} <= 0 THEN 0.0 END'), 20)}"), 0, 100))

    # price
    one("typical_price", c("(high + low + close) / 3"))
    one("median_price", c("(high + low) / 2"))
    one("weighted_close", c("(high + low + 2 * close) / 4"))
    one("ohlc4", c("(open + high + low + close) / 4"))
    one("range_pct", c("100 * (high - low) / close"))
    one("body_pct", c("100 * (close - open) / nullif(high - low, 0)"))
    one("upper_wick_pct", c("100 * (high - greatest(open, close)) / nullif(high - low, 0)"))
    one("lower_wick_pct", c("100 * (least(open, close) - low) / nullif(high - low, 0)"))
    one("gap_pct", lambda q: q.pct("open", q.lag("close")))
    one("clv", lambda q: q.clv())
    one("intraday_return", c("100 * (close / open - 1)"))
    one("price_change", lambda q: q.diff("close"))
    return f


# Decimals compared where six would fall on exact ties (averages of two-decimal prices) or beyond the
# precision of large values.
DIGITS = {"vwma": 8, "envelope": 9, "ease_of_movement": 2, "pvt": 3, "obv": 3, "ad_line": 4, "klinger": 3}


# Running products grow without bound on these tables; their logarithm is compared.
LOGGED = ("nvi", "pvi")


def indicator_sql() -> dict[str, str]:
    result = {}
    for name, form in _forms().items():
        q = Q()
        columns = {key: f"ln({x})" if name in LOGGED else x for key, x in form(q).items()}
        result[f"indicator_{name}"] = q.outputs(DIGITS.get(name, 6), **columns)
    return result

