"""Sequential counterparts the tests compare with."""


def mulberry(seed):
    state, mask = [seed], 0xFFFFFFFF

    def draw():
        state[0] = s = (state[0] + 0x6D2B79F5) & mask
        t = ((s ^ (s >> 15)) * (1 | s)) & mask
        t = ((t + (((t ^ (t >> 7)) * (61 | t)) & mask)) & mask) ^ t
        return ((t ^ (t >> 14)) & mask) / 4294967296
    return draw
