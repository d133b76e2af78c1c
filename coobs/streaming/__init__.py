"""Nothing stateful lives here, by design: the computations of this library are batch.

Operators that treat each row on its own or look it up in static tables work on a
``readStream`` source unchanged: ``tables.normalise_labels``, ``tables.assert_domain``,
``tables.partner_lookup`` (static pool), ``tables.override`` (static labels),
``score.clip_to_train`` and ``score.fill_missing`` (static ranges).
"""
