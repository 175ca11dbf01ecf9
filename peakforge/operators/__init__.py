"""peakforge.operators"""
