"""peakforge.functions"""
