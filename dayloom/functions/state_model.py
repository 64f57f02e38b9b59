"""The behaviour-state model: standardiser and cluster centres.

The defaults are fixed values of the published model; another model of the same
shape can be read from JSON (see :func:`dayloom.sources.configs.load_state_model`).
"""

from __future__ import annotations

from dataclasses import dataclass

from dayloom.vocab import STATE_FEATURES

# --- fixed values: model parameters, in STATE_FEATURES order ----------------
STATE_NAMES = (
    "media-heavy",
    "mixed high-activity work",
    "development-heavy",
    "mixed browser/writing/research",
    "file-management-heavy",
    "uncategorized/other-heavy",
)
MEAN = (
    42.4467538210659, 0.707445897017765, 81.48988214365133, 4.437180342450523,
    1.0457544841159132, -0.18254641314508155, -0.38756024396353383, 0.31187542390134126,
    0.10269951761620405, 0.13279496901740293, 0.04826271534037654, 0.06487199526586473,
    0.04935949385395871, 0.0400684754061282, 0.07053618074113585, 0.1026367097422483,
    0.0, 0.061106215802019456,
)
SCALE = (
    20.182461051175036, 0.3363743508529172, 81.9060703254459, 2.4172543102520065,
    0.7595416835668249, 0.6367441520836178, 0.6411167983558893, 0.3614646748454212,
    0.20867612849820408, 0.23117550836656536, 0.1448441401212494, 0.2120338038576264,
    0.14240019122256078, 0.1208779795359831, 0.1692931495178669, 0.2063199104738118,
    1.0, 0.21971711319744064,
)
CENTERS = (
    (
        -0.4712721969177823, -0.4712721969177825, -0.6357115719935797, -0.5066600253031008,
        -0.6463385536113336, -0.3674163246700754, 1.2075143456867232, -0.7289148440169214,
        -0.44444614494281576, -0.5017652985997977, -0.3025583721850762, 3.7074873600364304,
        -0.2428587522793711, -0.2955904976080781, -0.3706106026850875, -0.2923300024326538,
        0.0, -0.27723634876658454,
    ),
    (
        0.4613213784150861, 0.4613213784150862, 0.8318731681087375, 0.8514356363864032,
        0.8220028247405957, 0.08452083917850942, -0.4380395292288517, -0.02437798334275007,
        -0.07633488496774045, 0.11163922985143514, 0.054050510628206296, -0.20288610786021477,
        0.15793633201374524, 0.27026862125912904, 0.18293295867115755, 0.018320506760821503,
        0.0, -0.1820429963614168,
    ),
    (
        -1.4269205408415246, -1.426920540841525, -0.5717680226345673, -0.6437105763388286,
        -0.589109934721262, -0.015490881424976774, 0.2511460161984906, 0.6951139732870578,
        -0.3781799441829447, -0.18248720123134454, -0.14809099906614884, -0.2596564087176575,
        0.07379282282027733, 0.010172481533965685, -0.1831608315630965, -0.1551650817915418,
        0.0, -0.26432998035456,
    ),
    (
        0.11645725248450182, 0.11645725248450188, -0.24263786283777042, 0.06143226481396124,
        0.04490206903810425, -0.11847587044716886, -0.22836268084473452, -0.6033212476091813,
        2.76411364725294, -0.3131199718518723, -0.14403463251846774, -0.2511197331221371,
        -0.19292239891425228, -0.24225823967665852, -0.17827500502159363, -0.2864035702605325,
        0.0, -0.22945609243132065,
    ),
    (
        0.6539397875072632, 0.6539397875072634, -0.5868012716800094, -0.7090549179980775,
        -0.6275150452655314, -0.14764076285429012, 0.40888711729172456, -0.014874303060983703,
        -0.42542965980128394, 0.457557819845001, 0.34089278497329367, -0.2776393197251547,
        -0.18386515246273388, -0.31492592982845474, 0.15091022619794925, 0.5341872228302323,
        0.0, -0.2633076401638014,
    ),
    (
        0.6226868293098464, 0.6226868293098465, -0.886353913362202, -0.9790616209995098,
        -1.0625869298580677, 0.5160008552429214, -0.06338322262917685, -0.8275863978229792,
        -0.4639721345734114, -0.5009498199347905, -0.329424403383091, -0.291327416397288,
        -0.3072503684106148, -0.3249697726243149, -0.4048797099116859, -0.44060452122326854,
        0.0, 4.003003129171748,
    ),
)


@dataclass(frozen=True)
class StateModel:
    """Standardiser and centres over ``features``; shapes are checked."""

    features: tuple[str, ...] = tuple(STATE_FEATURES)
    mean: tuple[float, ...] = MEAN
    scale: tuple[float, ...] = SCALE
    centers: tuple[tuple[float, ...], ...] = CENTERS
    names: tuple[str, ...] = STATE_NAMES

    def __post_init__(self) -> None:
        width = len(self.features)
        if len(self.mean) != width or len(self.scale) != width:
            raise ValueError("state model: mean and scale must have one value per feature")
        if any(len(center) != width for center in self.centers):
            raise ValueError("state model: centres must have one value per feature")
        if len(self.names) != len(self.centers):
            raise ValueError("state model: one name per centre is needed")

    @property
    def n_states(self) -> int:
        return len(self.centers)


DEFAULT_STATE_MODEL = StateModel()
