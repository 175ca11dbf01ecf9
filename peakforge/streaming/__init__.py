"""peakforge.streaming"""
