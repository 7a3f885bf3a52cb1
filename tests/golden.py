"""A published return series (date, long-short return, long return, combined turnover) and its published figures."""

SERIES = [
    ("2017-01-31", -0.07067376597384516, -0.007182183831972107, 2.0),
    ("2017-04-30", -0.06332198934220293, -0.016718578375300244, 1.1666666666666665),
    ("2017-07-31", -0.05478541673777403, 0.00689237629278, 1.2916666666666665),
    ("2017-10-31", 0.05446214783924912, 0.14241124796058688, 1.2708333333333335),
    ("2018-01-31", 0.011384669363856882, -0.021335163844672933, 1.0),
    ("2018-04-30", 0.03642447024868636, 0.09199300967702367, 1.3333333333333335),
    ("2018-07-31", -0.06590717554835478, -0.06700804325823931, 1.163265306122449),
    ("2018-10-31", 0.01689608362980037, 0.05359512208760292, 1.399234693877551),
    ("2019-01-31", -0.004304516013973594, 0.08233679183276799, 1.3333333333333335),
    ("2019-04-30", -0.10199373601611286, -0.052879678139282495, 1.2083333333333335),
    ("2019-07-31", -0.03975538604947189, -0.020413342938003082, 1.4375),
    ("2019-10-31", 0.02300320892965816, 0.07346757909199493, 1.375),
    ("2020-01-31", -0.0947113619729619, -0.21860985311555686, 1.2653061224489797),
    ("2020-04-30", -0.057091700133078155, 0.09381514928569101, 1.489795918367347),
    ("2020-07-31", 0.04418452510239026, 0.043606931450994285, 0.9591836734693877),
    ("2020-10-31", 0.38106534124888286, 0.4479522678350794, 0.8775510204081634),
    ("2021-01-31", 0.13470637107960917, 0.26922419938642594, 1.163265306122449),
    ("2021-04-30", -0.04843250684895721, 0.00010070333639989678, 1.3877551020408163),
    ("2021-07-31", 0.0006391584589543267, 0.0372167212786224, 1.306122448979592),
    ("2021-10-31", 0.0067471989363182445, 0.014850540511474958, 1.3673469387755102),
    ("2022-01-31", -0.07416462572553344, -0.07160144130984271, 1.3265306122448979),
    ("2022-04-30", -0.03416624299977048, -0.035832310871220595, 1.1020408163265305),
    ("2022-07-31", 0.07378756418687207, 0.02984656446691213, 0.9387755102040816),
    ("2022-10-31", 0.055232882001617384, 0.12089727808964032, 1.0408163265306123),
    ("2023-01-31", -0.05047846392246839, -0.07539794575838328, 1.2857142857142856),
    ("2023-04-30", 0.12902279794263638, 0.16182378615202767, 1.2448979591836733),
    ("2023-07-31", -0.13724592004055458, -0.2076417472982044, 1.2653061224489797),
    ("2023-10-31", 0.08915117375066442, 0.22821912700971944, 1.2857142857142856),
    ("2024-01-31", 0.003232471977191193, 0.033611964491958156, 1.306122448979592),
    ("2024-04-30", 0.02098672193237617, 0.0798962251414589, 1.306122448979592),
    ("2024-07-31", -0.06924091421685016, -0.009343710858692929, 1.2448979591836733),
    ("2024-10-31", 0.02224204812478686, 0.040620600667290285, 1.2448979591836733),
    ("2025-01-31", -0.0878340202575775, -0.1059143317374011, 1.3265306122448979),
    ("2025-04-30", 0.22502858249194282, 0.2205585749081992, 1.489795918367347),
    ("2025-07-31", 0.07561642444682451, 0.07067073316084121, 1.3265306122448979),
    ("2025-10-31", 0.08471152271076583, 0.10773169992928154, 1.25),
]
FIGURES = {
    "long_short": {"ann_return": 0.048268624733732925, "ann_vol": 0.19897030109918298, "sharpe": 0.2425921078024198, "sharpe_ci_low": -0.49819354436069124, "sharpe_ci_high": 0.8058141179536159, "sharpe_p_value": 0.4787, "max_drawdown": -0.3030627527353739, "turnover_mean": 1.250862487852284},
    "long_only": {"ann_return": 0.17127342918977786, "ann_vol": 0.251685078186015, "sharpe": 0.6805068875127884, "sharpe_ci_low": 0.059131440864813145, "sharpe_ci_high": 1.3409717943326236, "sharpe_p_value": 0.0489, "max_drawdown": -0.22177553586160836, "turnover_mean": 0.5593780369290572},
}
