from seqframe.operators import aggregate as ag
from seqframe.operators import sorting as so
from seqframe.plans import policy
from seqframe.sources import sequences as src


def test_policies_agree(spark):
    s = src.counting(spark, 100)
    want = ag.reduce(s).head().result
    for p in (policy.seq, policy.unseq, policy.par, policy.par_unseq, policy.device_policy):
        assert policy.is_execution_policy(p) and p(ag.reduce, s).head().result == want
    assert policy.seq(so.sort, s, descending=True).rdd.getNumPartitions() == 1 and not policy.is_execution_policy("par")
