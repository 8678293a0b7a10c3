"""DuckDB SQL for every query: recordings as rows of samples, spectra as sums of cosines and sines."""

from __future__ import annotations

from checks import rules

SERIES = "'ElectricalSeries_sEEG'"


def _rule(rule: dict[str, str]) -> str:
    return ", ".join(f'{text} AS "{"group" if name == "grp" else name}"' for name, text in rule.items())


CTE = {
    "bands": (
        "SELECT * FROM (VALUES ('delta', 1.0::DOUBLE, 4.0::DOUBLE, 0), ('theta', 4.0, 8.0, 1), ('alpha', 8.0, 12.0, 2), "
        "('beta', 15.0, 25.0, 3), ('gamma', 25.0, 70.0, 4), ('high_gamma', 70.0, 170.0, 5)) AS t(band, fmin, fmax, band_idx)"
    ),
    "sig_emb": (
        "SELECT 'emb' AS run_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS channel_pos, vec_id AS sample_idx, "
        "CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings"
    ),
    "sig_ev": (
        f"SELECT 'ev-' || CAST(event_id // {rules.EV_RUN} AS VARCHAR) AS run_id, "
        f"CAST(event_id % {rules.EV_RUN} % {rules.EV_CHANNELS} AS INTEGER) AS channel_pos, "
        f"(event_id % {rules.EV_RUN}) // {rules.EV_CHANNELS} AS sample_idx, "
        f"CAST(CAST(value AS FLOAT) AS DOUBLE) / {rules.EV_SCALE} AS value FROM events"
    ),
    "sig": "SELECT * FROM sig_emb UNION ALL SELECT * FROM sig_ev",
    "sig_drop": (
        "SELECT run_id, channel_pos, sample_idx, CASE WHEN channel_pos % 7 = 0 AND sample_idx >= 200 AND sample_idx < 300 "
        "THEN 0.0 ELSE value END AS value FROM sig_emb"
    ),
    "sig_two": (
        f"SELECT run_id, {SERIES} AS series_name, channel_pos, sample_idx, value FROM sig_emb UNION ALL "
        f"SELECT run_id, '{rules.SECOND_SERIES}', channel_pos, (sample_idx // 5) * 3 + sample_idx % 5, CAST(CAST(value * 0.5 AS FLOAT) AS DOUBLE) FROM sig_emb WHERE sample_idx % 5 < 3"
    ),
    "rec_two": (
        "SELECT run_id, series_name, max(sample_idx) + 1 AS n_samples, CASE WHEN series_name = "
        f"{SERIES} THEN 400.0::DOUBLE ELSE 250.0::DOUBLE END AS sfreq FROM sig_two GROUP BY ALL"
    ),
    "sig_second": f"SELECT run_id, channel_pos, sample_idx, value FROM sig_two WHERE series_name = '{rules.SECOND_SERIES}'",
    "sig_broken": (
        "SELECT run_id, channel_pos, sample_idx, value FROM sig WHERE NOT (run_id = 'emb' AND ((channel_pos = 5 AND sample_idx // 128 = 2) OR (channel_pos = 9 AND sample_idx // 128 = 0))) "
        "UNION ALL SELECT run_id, channel_pos, sample_idx, value FROM sig WHERE run_id = 'ev-0' AND channel_pos = 3 AND sample_idx // 64 = 1"
    ),
    "gaps": (
        "SELECT run_id, channel_pos, min(bad) AS first_bad_sample, arg_min(problem, bad) AS problem FROM ("
        "SELECT run_id, channel_pos, CASE WHEN sample_idx = before THEN sample_idx ELSE before + 1 END AS bad, CASE WHEN sample_idx = before THEN 'repeated' ELSE 'missing' END AS problem "
        "FROM (SELECT run_id, channel_pos, sample_idx, lag(sample_idx, 1, -1) OVER (PARTITION BY run_id, channel_pos ORDER BY sample_idx) AS before FROM sig_broken) "
        "WHERE sample_idx <> before + 1) GROUP BY run_id, channel_pos"
    ),
    "rec": (
        "SELECT run_id, max(sample_idx) + 1 AS n_samples, CAST(count(DISTINCT channel_pos) AS INTEGER) AS n_channels, "
        "CASE WHEN run_id LIKE 'ev-%' AND CAST(regexp_extract(run_id, '(\\d+)$', 1) AS INTEGER) % 2 = 1 "
        "THEN 500.0::DOUBLE ELSE 400.0::DOUBLE END AS sfreq FROM sig GROUP BY run_id"
    ),
    "emb_pos": "SELECT DISTINCT CAST(unnest(range(len(embedding))) AS INTEGER) AS pos FROM embeddings",
    "elec_emb": f"SELECT 'emb' AS run_id, {_rule(rules.EMB_ELECTRODES)} FROM emb_pos",
    "cmap_emb": "SELECT 'emb' AS run_id, 63 - pos AS channel_pos, 100 + pos AS electrode_id FROM emb_pos",
    "part_pos": f"SELECT *, {rules.PART_RUN} AS run_id, {rules.PART_POS} AS pos FROM part",
    "elec_part": f"SELECT run_id, {_rule(rules.PART_ELECTRODES)} FROM part_pos",
    "cmap_part": "SELECT run_id, 63 - pos AS channel_pos, 100 + pos AS electrode_id FROM part_pos",
    "ev_ch": "SELECT DISTINCT run_id, channel_pos FROM sig_ev",
    "elec_ev": f"SELECT run_id, {_rule(rules.EV_ELECTRODES)} FROM ev_ch",
    "cmap_ev": "SELECT run_id, channel_pos, 500 + channel_pos AS electrode_id FROM ev_ch",
    "elec_all": "SELECT run_id, electrode_id, location FROM elec_emb UNION ALL SELECT run_id, electrode_id, location FROM elec_ev",
    "cmap_all": "SELECT * FROM cmap_emb UNION ALL SELECT * FROM cmap_ev",
    "files": (
        f"SELECT {rules.RUN_PATH} AS path, {rules.RESULT_PATH} AS output_path, c_custkey, c_nationkey FROM customer"
    ),
    "found": (
        "SELECT path AS input_path, output_path, c_custkey, c_nationkey FROM files "
        "WHERE path LIKE '/data/sub-%/ses-%/ieeg/sub-%\\_ses-%\\_run-%.nwb' ESCAPE '\\'"
    ),
}

# Which of the pieces above each one is built from.
NEEDS = {
    "sig": ["sig_emb", "sig_ev"], "sig_drop": ["sig_emb"], "rec": ["sig"], "elec_emb": ["emb_pos"], "cmap_emb": ["emb_pos"],
    "elec_part": ["part_pos"], "cmap_part": ["part_pos"], "ev_ch": ["sig_ev"], "elec_ev": ["ev_ch"], "cmap_ev": ["ev_ch"],
    "elec_all": ["elec_emb", "elec_ev"], "cmap_all": ["cmap_emb", "cmap_ev"], "found": ["files"],
    "sig_two": ["sig_emb"], "rec_two": ["sig_two"], "sig_second": ["sig_two"], "sig_broken": ["sig"], "gaps": ["sig_broken"],
}


def sql(final: str, *steps: str | tuple[str, str]) -> str:
    """One statement of the named pieces (with what they need) and extra (name, text) steps."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        parts.setdefault(name, CTE[name])

    for step in steps:
        if isinstance(step, str):
            add(step)
        else:
            parts[step[0]] = step[1]
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items()) + "\n" + final


PATTERN = r"^([A-Za-z]+)(\d+)$"


def parsed(elec: str) -> tuple[str, str]:
    return (
        "parsed",
        f"SELECT *, NULLIF(regexp_extract(location, '{PATTERN}', 1), '') AS shaft, "
        f"TRY_CAST(NULLIF(regexp_extract(location, '{PATTERN}', 2), '') AS BIGINT) AS contact_num FROM {elec}",
    )


NEIGHBOURS = (
    "neighbours",
    "SELECT run_id, shaft, contact_num, electrode_id, location, lead(electrode_id) OVER w AS next_id, "
    "lead(location) OVER w AS next_location, lead(contact_num) OVER w AS next_num FROM parsed WHERE shaft IS NOT NULL "
    "WINDOW w AS (PARTITION BY run_id, shaft ORDER BY contact_num, electrode_id)",
)
PAIRS = (
    "pairs",
    "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY shaft, contact_num, electrode_id) - 1 AS INTEGER) AS pair_idx, "
    "shaft, electrode_id AS anode_id, next_id AS cathode_id, location AS anode_location, next_location AS cathode_location, "
    "contact_num AS anode_contact, next_num AS cathode_contact, location || '-' || next_location AS location "
    "FROM neighbours WHERE next_num - contact_num = 1",
)


def pair_steps(elec: str) -> list:
    return [elec] * (elec in CTE) + [parsed(elec), NEIGHBOURS, PAIRS]


def bip(sig: str, cmap: str) -> tuple[str, str]:
    return (
        "bip",
        f"SELECT p.run_id, p.pair_idx, p.location, a.sample_idx, a.value - c.value AS value FROM pairs p "
        f"JOIN {cmap} ma ON ma.run_id = p.run_id AND ma.electrode_id = p.anode_id "
        f"JOIN {cmap} mc ON mc.run_id = p.run_id AND mc.electrode_id = p.cathode_id "
        f"JOIN {sig} a ON a.run_id = p.run_id AND a.channel_pos = ma.channel_pos "
        f"JOIN {sig} c ON c.run_id = p.run_id AND c.channel_pos = mc.channel_pos AND c.sample_idx = a.sample_idx",
    )


def bipolar_steps(which: str = "emb", sig: str | None = None, elec: str | None = None) -> list:
    """Pairs and their signal for 'emb', 'ev' or 'all' recordings."""
    signal = sig or ("sig" if which == "all" else f"sig_{which}")
    table = elec or f"elec_{which}"
    return ["rec", signal, *([table] if table in CTE else []), f"cmap_{which}", parsed(table), NEIGHBOURS, PAIRS, bip(signal, f"cmap_{which}")]


def welch_groups(nperseg: int, overlap: float, bin_sec: float, max_freq: float) -> list:
    """Time bins, the segments in each and the transform length."""
    noverlap = int(nperseg * overlap)
    return [
        ("lay", f"SELECT run_id, sfreq, {nperseg} AS n, {noverlap} AS nov, CAST(floor({bin_sec} * sfreq) AS BIGINT) AS len FROM rec"),
        ("grp", "SELECT b.run_id, b.pair_idx, b.location, b.sample_idx // l.len AS bin_idx, min(b.sample_idx) AS start, "
                "count(*) AS size, l.sfreq, l.nov, least(l.n, count(*)) AS n_eff, "
                f"greatest(CAST(floor(l.n * ({max_freq} / (l.sfreq / 2))) AS BIGINT), l.n) AS nfft "
                "FROM bip b JOIN lay l ON l.run_id = b.run_id "
                "GROUP BY b.run_id, b.pair_idx, b.location, b.sample_idx // l.len, l.sfreq, l.nov, l.n"),
        ("grp_t", "SELECT *, (start + size / 2) / sfreq AS time_sec FROM grp"),
        ("seg", "SELECT *, start + w * (n_eff - nov) AS seg_start FROM (SELECT *, unnest(range((size - nov) // (n_eff - nov))) AS w "
                "FROM grp_t WHERE n_eff > nov) AS s"),
    ]


def hop_groups(n: str, nov: str) -> list:
    """Hopping windows over the whole signal of a pair, each a group of its own."""
    return [
        ("lay", f"SELECT run_id, sfreq, CAST({n} AS BIGINT) AS n, CAST({nov} AS BIGINT) AS nov FROM rec"),
        ("whole", "SELECT b.run_id, b.pair_idx, b.location, count(*) AS size, l.sfreq, l.nov, least(l.n, count(*)) AS n_eff "
                  "FROM bip b JOIN lay l ON l.run_id = b.run_id GROUP BY b.run_id, b.pair_idx, b.location, l.sfreq, l.nov, l.n"),
        ("seg", "SELECT *, bin_idx AS w, n_eff AS nfft, bin_idx * (n_eff - nov) AS seg_start, "
                "(bin_idx * (n_eff - nov) + n_eff / 2) / sfreq AS time_sec FROM (SELECT *, unnest(range((size - nov) // (n_eff - nov))) AS bin_idx "
                "FROM whole WHERE n_eff > nov) AS s"),
        ("grp_t", "SELECT * FROM seg"),
    ]


def spectrum_steps(detrend: bool = True) -> list:
    """Density of every segment at every frequency."""
    mean = "avg(b.value) OVER (PARTITION BY s.run_id, s.pair_idx, s.bin_idx, s.w)" if detrend else "0"
    return [
        ("tapered", f"SELECT s.run_id, s.pair_idx, s.bin_idx, s.w, s.nfft, s.n_eff, s.sfreq, b.sample_idx - s.seg_start AS i, "
                    f"(b.value - {mean}) * (0.5 - 0.5 * cos(2 * pi() * (b.sample_idx - s.seg_start) / s.n_eff)) AS x "
                    "FROM seg s JOIN bip b ON b.run_id = s.run_id AND b.pair_idx = s.pair_idx "
                    "AND b.sample_idx >= s.seg_start AND b.sample_idx < s.seg_start + s.n_eff"),
        ("ks", "SELECT nfft, unnest(range(nfft // 2 + 1)) AS k FROM (SELECT DISTINCT nfft FROM seg)"),
        ("dft", "SELECT t.run_id, t.pair_idx, t.bin_idx, t.w, t.nfft, t.n_eff, t.sfreq, ks.k, "
                "sum(x * cos(2 * pi() * ((ks.k * t.i) % t.nfft) / t.nfft)) AS re, sum(x * sin(2 * pi() * ((ks.k * t.i) % t.nfft) / t.nfft)) AS im "
                "FROM tapered t JOIN ks ON ks.nfft = t.nfft GROUP BY ALL"),
        ("psd", "SELECT run_id, pair_idx, bin_idx, w, k, k * sfreq / nfft AS freq, (re * re + im * im) / (sfreq * 0.375 * n_eff) "
                "* CASE WHEN k = 0 OR (nfft % 2 = 0 AND k = nfft // 2) THEN 1 ELSE 2 END AS psd FROM dft"),
    ]


BAND_POWER = (
    "power",
    "SELECT g.run_id, g.bin_idx, g.time_sec, g.pair_idx, g.location, d.band, avg(p.psd) AS power "
    "FROM grp_t g CROSS JOIN bands d LEFT JOIN psd p ON p.run_id = g.run_id AND p.pair_idx = g.pair_idx AND p.bin_idx = g.bin_idx "
    "AND p.freq >= d.fmin AND p.freq < d.fmax GROUP BY ALL",
)


def welch_power(which: str, nperseg: int, overlap: float, bin_sec: float, max_freq: float, elec: str | None = None, extra=()) -> list:
    return [*extra, *bipolar_steps(which, elec=elec), "bands", *welch_groups(nperseg, overlap, bin_sec, max_freq), *spectrum_steps(), BAND_POWER]


def hop_power(which: str, n: str, nov: str, elec: str | None = None, extra=()) -> list:
    return [*extra, *bipolar_steps(which, elec=elec), "bands", *hop_groups(n, nov), *spectrum_steps(), BAND_POWER]


ROUNDED_POWER = (
    "SELECT run_id, bin_idx, round(time_sec, 9) AS time_sec, pair_idx, location, band, round(power, 10) + 0.0 AS power FROM power"
)
