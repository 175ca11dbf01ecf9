"""peakforge.sources"""
