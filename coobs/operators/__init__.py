"""DataFrame-to-DataFrame operators.

Every operator handles all properties at once; a property is a grouping column,
never a Python loop (model fits of the ML library excepted).
"""
