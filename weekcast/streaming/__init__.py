"""No streaming operators.

Inputs are bounded pulls and outputs are slice overwrites, so there is no
watermark, stateful operator or late-data rule to express here.
"""
