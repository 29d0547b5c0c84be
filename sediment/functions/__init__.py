from sediment.functions import numbers, sketches, text, times

__all__ = ["numbers", "sketches", "text", "times"]
