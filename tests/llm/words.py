def thue_morse(n, flip=False):
    """A word of the letters a and b and its complement: equal under every polynomial hash modulo a power of two once n is 1024 or more."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))
